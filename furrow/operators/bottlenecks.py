"""How wide a way between two parts of an area is at its narrowest, for all pairs of all fields at once.

The width is twice the largest distance by which the area can shrink before no connected part of it reaches both
supports. `ways` distances of every pair are tried together in a round: the areas shrink (`overlay.inset`), fall into
parts (`faces.parts_of`), and parts that overlap both supports say that the distance still passes. The largest one that
does and the next one bound the following round, so every round divides the interval by ways + 1. More ways take fewer
rounds and more work; one way halves.

How it scales: pairs and distances are keys of the same shuffles, and no pair meets another. The state of a round is a row
a pair. Corners are rounded by chords of `quarter` steps to a right angle, so between two corners that face each other a
width may come out too large by a share of about 1 - cos(pi / (4 * quarter)); between straight sides it is exact. A pair
whose area is missing, or whose supports no part joins, has width 0. No Python runs on rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import faces as S
from furrow.operators import overlay as O
from furrow.operators.graph import kept


def joining_parts(areas: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], least_area: float = 1e-6, unit: float = O.UNIT) -> DataFrame:
    """Keys of those areas of which one connected part overlaps both supports by more than `least_area`."""
    keys = list(keys)
    parts = S.parts_of(areas, keys, unit).select(*keys, "face", *O.ENDS)
    faces = kept(parts.select(*keys, "face").distinct())
    both = first.withColumn("which", F.lit(1)).unionByName(second.withColumn("which", F.lit(2)))
    named = [*keys, "face", "which"]
    tried = parts.withColumn("which", F.explode(F.array(F.lit(1), F.lit(2)))).select(*named, *O.ENDS)
    shared = O.overlay_areas(tried, both.join(faces, keys).select(*named, *O.ENDS), named, unit).where(F.col("both") > least_area)
    return shared.groupBy(*keys, "face").agg(F.countDistinct("which").alias("n")).where("n = 2").select(*keys).distinct()


def bottleneck_widths(areas: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], clearance: float = 0.0, precision: float = 1e-6, ways: int = 15, least_area: float = 1e-6, unit: float = O.UNIT, quarter: int = 16) -> DataFrame:
    """(keys, width) for each key of the supports `first` and `second`, edges (keys, ends) as is `areas`.

    clearance: what `areas` lie inside the free space already, on each side; it is added to widths that aren't 0. The
    distance is found to within `precision`.
    """
    keys = list(keys)
    plain = [e.select(*keys, *O.ENDS) for e in (areas, first, second)]
    asked = plain[1].select(*keys).distinct().intersect(plain[2].select(*keys).distinct())
    box = plain[0].groupBy(*keys).agg((F.least(F.max("ax") - F.min("ax"), F.max("ay") - F.min("ay")) / 2).alias("high"))
    state = kept(asked.join(box, keys).select(*keys, F.lit(0.0).alias("low"), "high"))
    widest = state.agg(F.max("high")).first()[0] or 0.0
    rounds = max(0, math.ceil(math.log(max(widest / precision, 1.0)) / math.log(ways + 1) - 1e-9))
    steps = F.explode(F.sequence(F.lit(1), F.lit(ways))).alias("step")
    for _ in range(rounds):
        tried = kept(state.select(*keys, "low", "high", steps).withColumn("distance", F.col("low") + (F.col("high") - F.col("low")) * F.col("step") / (ways + 1)))
        named = [*keys, "step"]
        with_step = [e.join(tried.select(*named, "distance"), keys) for e in plain]
        left = kept(O.inset(with_step[0], F.col("distance"), [*named, "distance"], unit, quarter))
        pass_ = joining_parts(left.select(*named, *O.ENDS), *(e.select(*named, *O.ENDS) for e in with_step[1:]), named, least_area, unit)
        best = pass_.groupBy(*keys).agg(F.max("step").alias("best"))
        gap = (F.col("high") - F.col("low")) / (ways + 1)
        step = F.coalesce("best", F.lit(0))
        state = kept(state.join(best, keys, "left").select(*keys, (F.col("low") + gap * step).alias("low"), (F.col("low") + gap * (step + 1)).alias("high")))
    width = F.when(F.col("low") > 0, 2 * (clearance + F.col("low"))).otherwise(F.lit(0.0))
    return asked.join(state, keys, "left").select(*keys, F.coalesce(width, F.lit(0.0)).alias("width"))
