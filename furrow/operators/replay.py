"""Chronological replay along rows: what was worked first when, and lifted travel over what wasn't worked yet.

Work is (keys, u0, u1, at): an interval of a row and its time. Pieces between all ends of a row's intervals get the least
time of the work over them, so intervals may overlap, repeat and come in any order. Travel (keys, travel, u0, u1, at) may
pass what was worked before it and what is free from the start; the rest of its length is a violation. Work at the time of
the travel isn't before it, so future passes never serve. Rows are apart: everything is equi-joins and windows by row.

Null or empty intervals are left out; ends may be given in either order. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"u0": F.least("u0", "u1"), "u1": F.greatest("u0", "u1")}).where("u0 < u1 and u0 is not null and u1 is not null")


def first_worked(work: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, u0, u1, at): disjoint pieces of every row that work covers, with the least time; null times come first."""
    keys = list(keys)
    works = _ordered(work.select(*keys, F.col("u0").cast("double").alias("u0"), F.col("u1").cast("double").alias("u1"), "at"))
    ends = works.select(*keys, F.explode(F.array("u0", "u1")).alias("u0")).distinct()
    pieces = ends.withColumn("u1", F.lead("u0").over(Window.partitionBy(*keys).orderBy("u0"))).where("u1 is not null")
    over = works.select(*keys, F.col("u0").alias("w0"), F.col("u1").alias("w1"), F.struct(F.col("at").isNotNull().alias("known"), F.col("at").alias("at")).alias("when"))
    return pieces.join(over, keys).where("w0 <= u0 and u1 <= w1").groupBy(*keys, "u0", "u1").agg(F.min("when")["at"].alias("at"))


def unworked_travel(travel: DataFrame, work: DataFrame, keys: Sequence[str], free: DataFrame | None = None) -> DataFrame:
    """(keys, travel, at, length, unworked) of every travel: how much of it is over what isn't ready at its time.

    free: (keys, u0, u1) that is always ready, such as what lies outside the target.
    """
    keys = list(keys)
    all_work = work.select(*keys, "u0", "u1", "at")
    if free is not None:
        all_work = all_work.unionByName(free.select(*keys, "u0", "u1", F.lit(None).cast(work.schema["at"].dataType).alias("at")))
    ready = first_worked(all_work, keys).select(*keys, F.col("u0").alias("p0"), F.col("u1").alias("p1"), F.col("at").alias("since"))
    ways = _ordered(travel.select(*keys, "travel", F.col("u0").cast("double").alias("u0"), F.col("u1").cast("double").alias("u1"), "at"))
    met = ways.join(ready, keys, "left").withColumn("part", F.greatest(F.least("u1", "p1") - F.greatest("u0", "p0"), F.lit(0.0)))
    before = F.col("since").isNull() | (F.col("since") < F.col("at"))
    out = met.groupBy(*keys, "travel", "at", "u0", "u1").agg(F.coalesce(F.sum(F.when(before & F.col("p0").isNotNull(), F.col("part"))), F.lit(0.0)).alias("done"))
    return out.select(*keys, "travel", "at", (F.col("u1") - F.col("u0")).alias("length"), F.greatest(F.col("u1") - F.col("u0") - F.col("done"), F.lit(0.0)).alias("unworked"))
