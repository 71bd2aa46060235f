"""Planar subdivision: regions cut by lines into faces, and what bounds, joins and measures the faces.

Pieces between crossings (from `overlay`) are taken as two half-edges each, one for either side. Around every vertex the
half-edges that leave are ordered by their angle; the next edge of a face is the neighbour, clockwise, of the way back.
That map is a permutation, and the least half-edge of a cycle is found by pointer doubling: every round each half-edge
looks twice as far, so a boundary of n edges takes about log2 n rounds of one equi-join for all fields together. Cycles
that run round a hole are joined to the face in which they lie by the piece right below their first vertex.

Lines that end inside a face bound nothing and appear on both sides of it. Lines outside the region are left out. A region
without lines gives its connected parts. Empty tables give empty results. No Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import overlay as O
from furrow.operators import rings as R
from furrow.operators.graph import kept, linked

_PLAIN = ("copies", "lines")


def _pieces(region: DataFrame, lines: DataFrame | None, keys: Sequence[str], unit: float) -> DataFrame:
    """Pieces with a covered side: (keys, ends, up, down), both boolean: whether the region is above and below."""
    rows = O.snapped(region, keys, unit).withColumns({"n": F.lit(1).cast("long"), "copies": F.lit(1).cast("long"), "lines": F.lit(0).cast("long")})
    if lines is not None:
        rows = rows.unionByName(O.snapped(lines, keys, unit).withColumns({"n": F.lit(0).cast("long"), "copies": F.lit(0).cast("long"), "lines": F.lit(1).cast("long")}))
    merged = kept(O.merged_edges(rows, keys, ("n",), _PLAIN).where("n <> 0 or lines > 0"))
    pieces = kept(O.noded(merged, keys, ("n",), _PLAIN).where("n <> 0 or lines > 0"))
    found = O.with_windings(pieces, keys, ("n",), _PLAIN)
    sides = found.select(*keys, *O.ENDS, "lines", (F.col("below_n") > 0).alias("down"), (F.col("below_n") + F.col("n") > 0).alias("up"))
    return kept(sides.where("(up or down) and (up <> down or lines > 0)"))


def _half_edges(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, twin, next, ends) of half-edges with the region on their left; ids are hashes, apart within keys."""
    there = pieces.select(*keys, *O.ENDS, F.col("up").alias("inside"))
    back = pieces.select(*keys, F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("down").alias("inside"))
    name = lambda *c: F.xxhash64(*c)
    half = there.unionByName(back).withColumns({"id": name("ax", "ay", "bx", "by"), "twin": name("bx", "by", "ax", "ay"), "turn": F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))})
    # all that leave a vertex, counter-clockwise: what comes in by an edge's twin goes on by the edge before it
    around = Window.partitionBy(*keys, "ax", "ay").orderBy("turn")
    before = F.coalesce(F.lag("id").over(around), F.last("id").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ordered = half.select("*", before.alias("onward"))
    coming = ordered.select(*keys, F.col("twin").alias("id"), F.col("onward").alias("next"))
    return ordered.where("inside").drop("inside", "onward", "turn").join(coming, [*keys, "id"])


def cycles(half: DataFrame, keys: Sequence[str], every: int = 3) -> DataFrame:
    """(keys, id, cycle): the least id of each half-edge's cycle of `next`, by pointer doubling."""
    keys = list(keys)
    state = kept(half.select(*keys, "id", F.least("id", "next").alias("cycle"), F.col("next").alias("far"), F.lit(True).alias("changed")))
    # the pointer of a round is two steps on after the first
    rounds = 0
    while True:
        ahead = state.select(*keys, F.col("id").alias("far"), F.col("cycle").alias("c2"), F.col("far").alias("f2"))
        state = state.join(ahead, [*keys, "far"]).select(*keys, "id", F.least("cycle", "c2").alias("cycle"), F.col("f2").alias("far"), (F.col("c2") < F.col("cycle")).alias("changed"))
        rounds += 1
        if rounds % every == 0:
            state = kept(state)
            if state.where("changed").isEmpty():
                return state.select(*keys, "id", "cycle")


def subdivided(region: DataFrame, lines: DataFrame | None = None, keys: Sequence[str] = O.FIELD, unit: float = O.UNIT) -> DataFrame:
    """(keys, face, id, twin, ends): the edges of all faces that lines (keys, ends) cut a region into, face on the left.

    `face` is a number that is apart within keys. Ends are in metres.
    """
    keys = list(keys)
    pieces = _pieces(region, lines, keys, unit)
    half = kept(_half_edges(pieces, keys))
    named = half.join(cycles(half, keys), [*keys, "id"])
    named = kept(named.select(*keys, "cycle", "id", "twin", *O.ENDS))
    x, y = (lambda c: F.col(c) - F.col("ox")), (lambda c: F.col(c) - F.col("oy"))
    # about a corner of the cycle itself: differences are small and exact
    origin = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))
    first = named.groupBy(*keys, "cycle").agg(F.min(origin).alias("o"))
    placed = named.join(first, [*keys, "cycle"]).withColumns({"ox": F.col("o.x"), "oy": F.col("o.y")})
    turned = placed.groupBy(*keys, "cycle", "ox", "oy").agg(F.sum(x("ax") * y("by") - x("bx") * y("ay")).alias("area"))
    inner = turned.where("area <= 0").select(*keys, "cycle", F.col("ox").alias("x"), F.col("oy").alias("y"))
    # the piece right below a hole's first vertex, in its column of cells
    width = O.cell_widths(pieces, keys)
    column = lambda v: F.floor(v / F.col("cell"))
    above = pieces.where("up").join(width, keys).withColumn("column", F.explode(F.sequence(column(F.col("ax")), column(F.col("bx"))))).drop("cell")
    probes = inner.join(width, keys).withColumn("column", column(F.col("x"))).drop("cell")
    over = ((F.col("ax") < F.col("x")) | ((F.col("ax") == F.col("x")) & (F.col("ay") <= F.col("y")))) & ((F.col("x") < F.col("bx")) | ((F.col("x") == F.col("bx")) & (F.col("y") < F.col("by"))))
    high = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax")) > 0
    level = F.when(F.col("ax") == F.col("bx"), F.col("by")).otherwise(F.col("ay") + (F.col("x") - F.col("ax")) / (F.col("bx") - F.col("ax")) * (F.col("by") - F.col("ay")))
    under = probes.join(above, [*keys, "column"]).where(over & high).groupBy(*keys, "cycle").agg(F.max_by(F.xxhash64("ax", "ay", "bx", "by"), level).alias("id"))
    links = under.join(named.select(*keys, "id", F.col("cycle").alias("other")), [*keys, "id"])
    item = lambda c: F.struct(*(F.col(k) for k in keys), F.col(c).alias("cycle"))
    joined = linked(links.select(item("cycle").alias("a"), item("other").alias("b")))
    faces = joined.select(*(F.col(f"item.{k}").alias(k) for k in keys), F.col("item.cycle").alias("cycle"), F.col("label.cycle").alias("face"))
    out = named.join(faces, [*keys, "cycle"], "left").withColumn("face", F.coalesce("face", "cycle"))
    return kept(out.select(*keys, "face", "id", "twin", *((F.col(c) * unit).alias(c) for c in O.ENDS)))


def face_measures(faces: DataFrame, keys: Sequence[str] = O.FIELD) -> DataFrame:
    """(keys, face, area, perimeter)."""
    return O.measures(faces, (*keys, "face"))


def shared_borders(faces: DataFrame, keys: Sequence[str] = O.FIELD) -> DataFrame:
    """(keys, a, b, length) of pairs of faces a < b with a common border."""
    other = faces.select(*keys, F.col("twin").alias("id"), F.col("face").alias("b"))
    met = faces.withColumnRenamed("face", "a").join(other, [*keys, "id"]).where("a < b")
    return met.groupBy(*keys, "a", "b").agg(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("length"))


def parts_of(region: DataFrame, keys: Sequence[str] = O.FIELD, unit: float = O.UNIT) -> DataFrame:
    """(keys, face, ends): the connected parts of a region, each with its holes."""
    return subdivided(region, None, keys, unit)


def event_levels(framed: DataFrame, least_deg: float = 25.0, field: str = "field_id") -> DataFrame:
    """(field, level): heights v, in a field's frame, of notches that turn by more than `least_deg` and of holes' ends.

    framed: edges from `rings.in_frame`, with ring.
    """
    in_frame = framed.select(field, "ring", "i", *(F.col(f"{p}{a}").alias(f"{p}{b}") for p in "ab" for a, b in (("u", "x"), ("v", "y"))))
    notches = R.reflex_rays(in_frame, least_deg, field).select(field, F.col("y").alias("level"))
    holes = in_frame.where("ring <> 0").groupBy(field, "ring").agg(F.array(F.min("ay"), F.max("ay")).alias("ends")).select(field, F.explode("ends").alias("level"))
    return notches.union(holes).select(field, F.round("level", 6).alias("level")).distinct()


def spaced_levels(levels: DataFrame, framed: DataFrame, minimum: float, field: str = "field_id") -> DataFrame:
    """(field, level): of a field's levels those at least `minimum` above the one kept before and below the field's end.

    A field's levels are folded in order; they are as many as its notches, not as its edges.
    """
    ends = framed.groupBy(field).agg(F.min(F.least("av", "bv")).alias("low"), F.max(F.greatest("av", "bv")).alias("high"))
    sorted_ = levels.groupBy(field).agg(F.sort_array(F.collect_set("level")).alias("all")).join(ends, field)
    start = F.struct(F.col("low").alias("last"), F.array().cast("array<double>").alias("kept"))
    step = lambda s, v: F.when((v - s["last"] >= minimum) & (F.col("high") - v >= minimum), F.struct(v.alias("last"), F.concat(s["kept"], F.array(v)).alias("kept"))).otherwise(s)
    return sorted_.select(field, F.explode(F.aggregate("all", start, step)["kept"]).alias("level"))


def level_lines(levels: DataFrame, framed: DataFrame, keys: Sequence[str] = O.FIELD, field: str = "field_id") -> DataFrame:
    """Lines (keys, ends) in a field's frame along levels (keys, level), a metre longer than the field on both sides."""
    ends = framed.groupBy(field).agg((F.min(F.least("au", "bu")) - 1).alias("ax"), (F.max(F.greatest("au", "bu")) + 1).alias("bx"))
    return levels.join(ends, field).select(*keys, "ax", F.col("level").alias("ay"), "bx", F.col("level").alias("by"))


def along_frame(framed: DataFrame, *keep: str) -> DataFrame:
    """Edges in their frame: u and v as x and y."""
    return framed.select(*keep, *(F.col(f"{p}{a}").alias(f"{p}{b}") for p in "ab" for a, b in (("u", "x"), ("v", "y"))))
