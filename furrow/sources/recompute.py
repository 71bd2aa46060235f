"""Recomputation by contract: only fields whose input or parameters changed are computed again.

A field's contract is the digest of its input rows, whatever their order, and the id of the parameters. Fields whose
contract is committed are left out by an anti-join. Results of a run are one new partition of a table, which Spark moves
into place when the whole job has succeeded, so a reader sees the old state or the new one. A field's newest run holds;
fields that are no longer in the input are not current. Repeated rows count as often as they are there. Null keys are left
out. A run without changes writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.sources.store import commit, newest, parameter_id

_CONTRACT = ("input_digest", "parameter_set_id")


def input_digests(rows: DataFrame, key: str = "field_id") -> DataFrame:
    """(key, input_digest): the number of a key's rows and two independent sums of their hashes, as one digest."""
    columns = sorted(rows.columns)
    one, two = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.sum(two.cast("decimal(20,0)")).alias("b"))
    return sums.select(key, F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in "nab")), 256).alias("input_digest"))


def committed(spark: SparkSession, out: str, key: str = "field_id") -> DataFrame | None:
    """(key, run, contract) of the newest run of each key, or None before the first run."""
    try:
        return newest(spark, f"{out}/contracts", key)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def changed_fields(rows: DataFrame, done: DataFrame | None, parameters: dict, key: str = "field_id") -> DataFrame:
    """(key, input_digest, parameter_set_id) of the keys of `rows` whose contract isn't among those of `done`."""
    now = input_digests(rows, key).withColumn("parameter_set_id", F.lit(parameter_id(parameters)))
    return now if done is None else now.join(done.select(key, *_CONTRACT), [key, *_CONTRACT], "left_anti")


def recompute(spark: SparkSession, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], parameters: dict, out: str, key: str = "field_id") -> int:
    """Computes the changed fields and commits them under `out`; how many there were.

    `compute` maps rows to result rows with the key. Results are written before their contracts: a run that is lost between
    the two is done again, into the same partition.
    """
    done = committed(spark, out, key)
    number = 1 if done is None else (done.agg(F.max("run")).first()[0] or 0) + 1
    todo = changed_fields(rows, done, parameters, key)
    n = todo.count()
    if n:
        commit(compute(rows.join(todo.select(key), key, "left_semi")), f"{out}/results", number)
        commit(todo.withColumn("run", F.lit(number)), f"{out}/contracts", number)
    return n


def current(spark: SparkSession, rows: DataFrame, out: str, key: str = "field_id") -> DataFrame:
    """Results of the newest run of every key that `rows` still has."""
    last = committed(spark, out, key).select(key, F.col("run").alias("commit")).join(rows.select(key).distinct(), key, "left_semi")
    found = spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results")
    return found.join(last, [key, "commit"], "left_semi").drop("commit")
