"""Shortest guides inside fields with holes: a visibility graph of notches and ends, then relaxation for all fields at once.

A shortest way bends only at notches (vertices that turn away from the inside), so these and the ends of the wanted ways are
the graph's nodes. A pair sees each other if its line crosses no edge and lies inside. Lines are dealt to the cells along
them, and meet only edges of those cells. Ways are relaxed in rounds: every node that became nearer offers its neighbours
its length, as one join and grouped minimum over all ways; rounds are the most bends of a way, and only nodes that
changed take part. Node pairs of one field are the graph itself: their number is the square of its notches, not of its edges.

Ends outside the field, or that nothing connects, give no row. Ends on the boundary are inside. Equal lengths go to the
way that was found first and then to the lesser node. Empty tables give empty results. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators import overlay as O
from furrow.operators import rings as R
from furrow.operators.graph import kept


def visible_pairs(edges: DataFrame, nodes: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, a, b, length), both ways, of nodes (field, node, x, y) that see each other inside edges (field, ends).

    Touching the boundary, or running along it, hides nothing. Sight is told on the grid, length between the nodes as given.
    """
    unit = O.UNIT
    where = nodes.select(field, F.col("node").alias("a"), F.round(F.col("x") / unit).alias("ax"), F.round(F.col("y") / unit).alias("ay"), "x", "y")
    to = where.select(field, F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    met = where.join(to, field).where((F.col("a") < F.col("b")) & ((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))))
    lines = kept(met.select(field, "a", "b", *O.ENDS, F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y")).alias("length")))
    walls = O.snapped(edges.select(field, *O.ENDS), (field,), unit).where("ax <> bx or ay <> by")
    # cells as wide as the mean wall would cut long lines into very many pieces; a field's lines are longer
    size = walls.select(field, *O.ENDS).unionByName(lines.select(field, *O.ENDS))
    width = O.cell_widths(size, [field])
    named = {"ax": "px", "ay": "py", "bx": "qx", "by": "qy"}
    wall = O.dealt(walls.join(width, field)).select(field, "cx", "cy", *(F.col(c).alias(named[c]) for c in O.ENDS))
    line = O.dealt(lines.join(width, field)).select(field, "cx", "cy", "a", "b", *O.ENDS)
    side = lambda a, b, p: ((F.col(f"{b}x") - F.col(f"{a}x")) * (F.col(f"{p}y") - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (F.col(f"{p}x") - F.col(f"{a}x"))) / F.hypot(F.col(f"{b}x") - F.col(f"{a}x"), F.col(f"{b}y") - F.col(f"{a}y"))
    p, q, a, b = side("a", "b", "p"), side("a", "b", "q"), side("p", "q", "a"), side("p", "q", "b")
    far = F.least(F.abs(p), F.abs(q), F.abs(a), F.abs(b)) > 2
    hidden = line.join(wall, [field, "cx", "cy"]).where((p * q < 0) & (a * b < 0) & far).select(field, "a", "b").distinct()
    open_ = lines.join(hidden, [field, "a", "b"], "left_anti")
    # what crosses no wall lies inside as a whole or outside, but for lines through vertices: points along it tell
    at = [0.5, 0.123, 0.877]
    spots = open_.select(field, "a", "b", *O.ENDS, F.explode(F.array(*(F.lit(t) for t in at))).alias("t"))
    spots = spots.select(field, "a", "b", "t", ((F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))) * unit).alias("x"), ((F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))) * unit).alias("y"))
    within = _inside_or_on(spots, edges, [field, "a", "b", "t"], field).groupBy(field, "a", "b").agg(F.bool_and("inside").alias("inside")).where("inside").drop("inside")
    seen = open_.join(within, [field, "a", "b"]).select(field, "a", "b", "length")
    return kept(seen.unionByName(seen.select(field, F.col("b").alias("a"), F.col("a").alias("b"), "length")))


def _inside_or_on(points: DataFrame, edges: DataFrame, keys: list[str], field: str, near: float = 1e-5) -> DataFrame:
    """(keys, inside): even-odd, or nearer than `near` to an edge."""
    met = points.join(edges.select(field, *O.ENDS), field, "left")
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    gap = F.hypot(F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy)
    return met.groupBy(*keys).agg(((F.count_if(crosses) % 2 == 1) | F.coalesce(F.min(gap) <= near, F.lit(False))).alias("inside"))


def shortest(pairs: DataFrame, starts: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, way, node, length, via): the least length from each start (field, way, node) to every node it reaches."""
    state = kept(starts.select(field, "way", "node", F.lit(0.0).alias("length"), F.lit(None).cast(starts.schema["node"].dataType).alias("via"), F.lit(True).alias("fresh")))
    while True:
        offers = state.where("fresh").select(field, "way", F.col("node").alias("a"), F.col("length").alias("so_far")).join(pairs, [field, "a"])
        offers = offers.select(field, "way", F.col("b").alias("node"), (F.col("so_far") + F.col("length")).alias("length"), F.col("a").alias("via"), F.lit(True).alias("fresh"))
        both = state.withColumn("fresh", F.lit(False)).unionByName(offers)
        best = both.groupBy(field, "way", "node").agg(F.min_by(F.struct("length", "via", "fresh"), F.struct(F.round("length", 9), "fresh", "via")).alias("s"))
        state = kept(best.select(field, "way", "node", "s.*"))
        if state.where("fresh").isEmpty():
            return state.drop("fresh")


def guides(edges: DataFrame, ways: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, way, length, bends) of the shortest way inside its field of each row of ways (field, way, x0, y0, x1, y1).

    edges: (field, ring, i, ends) from `rings.edges_of`. way is a long and tells the ways of a field apart.
    """
    notches = R.reflex_rays(edges, 0.01, field).select(field, "x", "y").distinct()
    corner = notches.select(field, F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("way"), F.col("x").alias("x"), F.col("y").alias("y")).alias("node"), "x", "y")
    end = lambda k: ways.select(field, F.struct(F.lit(k).alias("kind"), F.col("way").cast("long").alias("way"), F.col(f"x{k - 1}").cast("double").alias("x"), F.col(f"y{k - 1}").cast("double").alias("y")).alias("node"), F.col(f"x{k - 1}").cast("double").alias("x"), F.col(f"y{k - 1}").cast("double").alias("y"))
    pairs = visible_pairs(edges, corner.unionByName(end(1)).unionByName(end(2)), field)
    # an end serves its own way only
    own = lambda c: F.col(f"{c}.kind") == 0
    pairs = pairs.where(own("a") | own("b") | (F.col("a.way") == F.col("b.way")))
    found = shortest(pairs, end(1).select(field, F.col("node.way").alias("way"), "node"), field).where((F.col("node.kind") == 0) | (F.col("node.way") == F.col("way")))
    arrived = found.where("node.kind = 2").select(field, "way", "length", F.col("via").alias("node"))
    # bends, back along the nodes before
    before = kept(found.select(field, "way", "node", F.col("via").alias("up")))
    state, bends = kept(arrived.select(field, "way", "length", "node", F.lit(0).alias("bends"))), None
    while bends is None or bends > 0:
        state = kept(state.join(before, [field, "way", "node"], "left").select(field, "way", "length", F.coalesce("up", "node").alias("node"), (F.col("bends") + (F.col("node.kind") == 0).cast("int")).alias("bends"), (F.col("node.kind") == 0).alias("on")))
        bends = state.where("on").limit(1).count()
    return state.select(field, "way", "length", "bends")
