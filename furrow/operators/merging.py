"""Agglomeration of neighbouring regions, for all keys at once: in every round regions choose, pairs merge, costs change.

Regions are rows (keys, region, and figures that add up, as `sum_*`, or whose greater counts, as `max_*`, or arrays of
such, as `far_*`); borders are rows (keys, a, b, length). The cost of a merger is a Column over a_<figure>, b_<figure> and
length, so it is anew in every round. Rounds are grouped minima and equi-joins over all keys; only their number depends on
the data. Two ways:

* `mutual`: all pairs merge that are each other's best. Where costs don't rise along a chain of regions, a constant share
  of them goes each round, so a chain takes a logarithmic number of rounds.
* `one_each`: only the best pair of every key merges in a round, as a sequential search would. Rounds are the most
  mergers of a key.

Ties go to the longer border, then to `tie`, then to the lesser regions. Regions without a border stay. Null costs forbid a
merger. Empty tables give no merger.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.graph import kept

DIRECTIONS = 64


def supports(edges: DataFrame, keys: Sequence[str], n: int = DIRECTIONS) -> DataFrame:
    """(keys, far_hull): how far each region reaches in `n` directions. Of a union it is the greater of each two."""
    reach = (F.max(F.col("ax") * math.cos(k * math.tau / n) + F.col("ay") * math.sin(k * math.tau / n)) for k in range(n))
    return edges.groupBy(*keys).agg(F.array(*reach).alias("far_hull"))


def hull_area(far: Column, n: int = DIRECTIONS) -> Column:
    """Area of the polygon that a region's reach in `n` directions bounds: its convex hull, with at most `n` sides.

    It is the hull itself where the hull's sides face such directions, and else a little more.
    """
    step = math.tau / n
    side = lambda k: (F.get(far, F.pmod(k - 1, F.lit(n))) + F.get(far, F.pmod(k + 1, F.lit(n))) - F.get(far, k) * (2 * math.cos(step))) / math.sin(step)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(far, k) * side(k) / 2), F.lit(0.0), lambda x, y: x + y)


def concavity(area: Column, far: Column, n: int = DIRECTIONS) -> Column:
    """The share of a region's hull that it doesn't fill."""
    hull = hull_area(far, n)
    return F.greatest((hull - area) / F.greatest(hull, F.lit(1e-9)), F.lit(0.0))


def merged_far(a: str = "a_far_hull", b: str = "b_far_hull") -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def hull_cost() -> Column:
    """The concavity of what a merger makes, to nine digits."""
    return F.round(concavity(F.col("a_sum_area") + F.col("b_sum_area"), merged_far()), 9)


def mixed(a: str = "a", b: str = "b") -> Column:
    """A tie-break that doesn't follow the regions' order, so that chains of equal costs shrink everywhere at once."""
    return F.pmod(F.xxhash64(a, b), F.lit(1 << 31))


def agglomerated(
    regions: DataFrame, borders: DataFrame, cost: Column, *, keys: Sequence[str] = ("field_id",), one_each: bool = False, wanted: Column | None = None, first: Column | None = None, tie: Column | None = None, every: int = 1,
) -> DataFrame:
    """(keys, level, kept, gone, cost): all mergers; in round `level`, from 1, region `gone` became part of `kept`, the lesser.

    wanted: a predicate over a_*, b_* and length that a merger must meet. first: what comes before cost in the order,
    such as the least invalid region's area; both are evaluated anew in every round. tie: after the border's length;
    the regions' order if `one_each`, a mixed order otherwise.
    """
    keys = list(keys)
    figures = [c for c in regions.columns if c not in (*keys, "region")]
    tie = tie if tie is not None else (F.lit(0) if one_each else mixed())
    nodes, links, levels, level = kept(regions), kept(borders.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length").where("a <> b")), None, 0
    while True:
        level += 1
        ends = [nodes.select(*keys, F.col("region").alias(e), *(F.col(f).alias(f"{e}_{f}") for f in figures)) for e in "ab"]
        options = links.join(ends[0], [*keys, "a"]).join(ends[1], [*keys, "b"])
        options = options.where(wanted) if wanted is not None else options
        rank = F.struct((first if first is not None else F.lit(0)).alias("first"), cost.alias("cost"), (-F.col("length")).alias("length"), tie.alias("tie"), F.col("a").alias("a"), F.col("b").alias("b"))
        options = options.select(*keys, "a", "b", rank.alias("rank")).where("rank.cost is not null")
        if one_each:
            pairs = options.groupBy(*keys).agg(F.min("rank").alias("rank"))
        else:
            each = options.select(*keys, F.explode(F.array("a", "b")).alias("region"), "rank").groupBy(*keys, "region").agg(F.min("rank").alias("rank"))
            pairs = each.groupBy(*keys, "rank").agg(F.count("*").alias("n")).where("n = 2")
        pairs = kept(pairs.select(*keys, F.lit(level).alias("level"), F.col("rank.a").alias("kept"), F.col("rank.b").alias("gone"), F.col("rank.cost").alias("cost")))
        if pairs.isEmpty():
            break
        levels = pairs if levels is None else levels.unionByName(pairs)
        to = pairs.select(*keys, F.col("gone").alias("region"), F.col("kept").alias("root"))
        moved = nodes.join(to, [*keys, "region"], "left").withColumn("region", F.coalesce("root", "region")).drop("root")
        combine = {"sum": F.sum, "max": F.max}
        aggs = []
        for f in figures:
            if f.startswith("far_"):
                # at most two regions become one in a round
                aggs.append(F.aggregate(F.collect_list(f), F.first(f), lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p, q))).alias(f))
            else:
                aggs.append(combine[f[:3]](f).alias(f))
        nodes = kept(moved.groupBy(*keys, "region").agg(*aggs))
        for e in "ab":
            links = links.join(to.withColumnsRenamed({"region": e}), [*keys, e], "left").withColumn(e, F.coalesce("root", e)).drop("root")
        links = kept(links.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("length").alias("length")))
    if levels is None:
        levels = pairs
    return kept(levels)


def assignments(regions: DataFrame, mergers: DataFrame, keys: Sequence[str] = ("field_id",)) -> DataFrame:
    """(keys, level, region, root) for every level of the mergers of a key, from 0: which region each one is part of."""
    keys = list(keys)
    last = mergers.groupBy(*keys).agg(F.max("level").alias("last"))
    state = kept(regions.select(*keys, "region", F.col("region").alias("root"), F.lit(0).alias("level")).join(last, keys, "left"))
    out, level = state, 0
    deepest = mergers.agg(F.max("level")).first()[0] or 0
    while level < deepest:
        level += 1
        step = mergers.where(F.col("level") == level).select(*keys, F.col("gone").alias("root"), "kept")
        state = kept(state.where(F.col("last") >= level).join(step, [*keys, "root"], "left").select(*keys, "region", F.coalesce("kept", "root").alias("root"), F.lit(level).alias("level"), "last"))
        out = out.unionByName(state)
    return out.drop("last")
