"""Recomputation by contract: what changes is computed again, readers see whole runs, removed fields go."""

import os

import pytest
from pyspark.sql import functions as F

from furrow.sources import recompute as C
from furrow.sources.store import commit, newest


def table(spark, rows):
    return spark.createDataFrame(rows, "field_id long, x double, name string")


def sums(rows):
    return rows.groupBy("field_id").agg(F.sum("x").alias("total"))


def values(df):
    return {r.field_id: r.total for r in df.collect()}


def test_only_changes_are_computed(spark, tmp_path):
    out, seen = str(tmp_path / "t"), []

    def compute(rows):
        seen.append(sorted({r.field_id for r in rows.collect()}))
        return sums(rows)

    rows = [(1, 1.0, "a"), (1, 2.0, None), (2, 5.0, "b"), (3, 7.0, "c"), (None, 1.0, "d")]
    first = table(spark, rows)
    assert C.recompute(spark, first, compute, {"w": 3.75}, out) == 3
    assert C.recompute(spark, table(spark, rows[::-1]), compute, {"w": 3.75}, out) == 0, "the order of rows doesn't matter"
    second = table(spark, [(1, 1.0, "a"), (1, 2.0, None), (2, 6.0, "b"), (4, 9.0, "e")])
    assert C.recompute(spark, second, compute, {"w": 3.75}, out) == 2
    assert values(C.current(spark, second, out)) == {1: 3.0, 2: 6.0, 4: 9.0}
    assert C.recompute(spark, second, compute, {"w": 4.0}, out) == 3, "other parameters change every field"
    assert seen == [[1, 2, 3], [2, 4], [1, 2, 4]]
    twice = table(spark, [(1, 1.0, "a"), (1, 2.0, None), (1, 2.0, None), (2, 6.0, "b"), (4, 9.0, "e")])
    assert C.recompute(spark, twice, compute, {"w": 4.0}, out) == 1, "a repeated row is a change"


def test_a_run_that_fails_leaves_the_old_state(spark, tmp_path):
    out = str(tmp_path / "t")
    old, new = table(spark, [(1, 1.0, "a"), (2, 2.0, "b")]), table(spark, [(1, 8.0, "a"), (2, 9.0, "b")])
    C.recompute(spark, old, sums, {}, out)

    def broken(rows):
        bad = F.when(F.col("field_id") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x"))
        return rows.repartition(2, "field_id").select("field_id", bad.alias("total"))

    with pytest.raises(Exception, match="lost"):
        C.recompute(spark, new, broken, {}, out)
    assert values(C.current(spark, new, out)) == {1: 1.0, 2: 2.0}
    assert C.recompute(spark, new, sums, {}, out) == 2 and values(C.current(spark, new, out)) == {1: 8.0, 2: 9.0}


def test_half_a_commit_is_not_seen(spark, tmp_path):
    """Files that a running job has staged don't belong to the table."""
    folder = str(tmp_path / "r")
    commit(spark.createDataFrame([(1, 1.0)], "field_id long, total double"), folder, 1)
    staged = tmp_path / "r" / ".spark-staging-x" / "commit=2"
    os.makedirs(staged)
    spark.createDataFrame([(1, 5.0)], "field_id long, total double").write.mode("overwrite").parquet(str(staged))
    assert values(newest(spark, folder)) == {1: 1.0}
    commit(spark.createDataFrame([(1, 3.0), (2, 4.0)], "field_id long, total double"), folder, 2)
    commit(spark.createDataFrame([(2, 6.0)], "field_id long, total double"), folder, 2)
    assert values(newest(spark, folder)) == {1: 1.0, 2: 6.0}, "written again, a commit replaces itself alone"
