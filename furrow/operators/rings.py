"""Polygons in general position as tables of vertices, by windows, equi-joins on the field and column arithmetic.

A ring is (field, ring, i, x, y), not closed; ring 0 is the outside, others are holes. `edges_of` gives its edges with the
inside on the left, whichever way the ring was drawn. Every operator takes edges of any direction and number; holes need
no care, since crossings pair up by the even-odd rule and areas are line integrals. Edges with null or non-finite
coordinates are left out, so a broken ring gives what its other edges say. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import finite_number, vector_angle_deg
from furrow.operators import overlay as O

KEYS = ("field_id", "ring")


def edges_of(vertices: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "i") -> DataFrame:
    """(keys, i, ax, ay, bx, by) of each ring, inside on the left: outsides run counter-clockwise and holes clockwise."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    good = vertices.where(finite_number(F.col("x").cast("double")) & finite_number(F.col("y").cast("double")))
    points = good.select(*keys, F.col(order).alias("i"), F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), *(F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).cast("double").alias(f"b{c}") for c in "xy"))
    points = points.withColumn("area", F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).over(Window.partitionBy(*keys)))
    turn = (F.col("area") < 0) != (F.col(keys[-1]) != 0)
    return points.where("ax <> bx or ay <> by").select(*keys, "i", *(F.when(turn, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("bx", "ax"), ("by", "ay"), ("ax", "bx"), ("ay", "by"))))


def in_frame(edges: DataFrame, angle: Column) -> DataFrame:
    """Edges with au, av, bu, bv: u along a direction and v across it, to its left."""
    c, s = F.cos(angle), F.sin(angle)
    return edges.withColumns({f"{p}{n}": (F.col(f"{p}x") * a + F.col(f"{p}y") * b) for p in "ab" for n, a, b in (("u", c, s), ("v", -s, c))})


def parallel_segments(edges: DataFrame, spacing: float, phase: float, field: str = "field_id") -> DataFrame:
    """(field, line, piece, u0, u1): pieces inside the polygon of the lines v = phase + line * spacing.

    edges: from `in_frame`. Each edge makes its own crossings, so the work follows the edges' extent; a line's crossings
    are paired in order of u.
    """
    lo, hi = F.least("av", "bv"), F.greatest("av", "bv")
    first, last = F.ceil((lo - phase) / spacing), F.ceil((hi - phase) / spacing) - 1
    cut = edges.where(first <= last).select(field, "au", "av", "bu", "bv", F.explode(F.sequence(first, last)).alias("line"))
    v = phase + F.col("line") * spacing
    cut = cut.select(field, "line", (F.col("au") + (v - F.col("av")) / (F.col("bv") - F.col("av")) * (F.col("bu") - F.col("au"))).alias("u0"))
    w = Window.partitionBy(field, "line").orderBy("u0")
    pieces = cut.select(field, "line", "u0", F.lead("u0").over(w).alias("u1"), F.row_number().over(w).alias("n")).where("n % 2 = 1 and u1 > u0")
    return pieces.select(field, "line", ((F.col("n") + 1) / 2).cast("int").alias("piece"), "u0", "u1")


def _integral(lo: Column, hi: Column) -> Column:
    """The integral of u dv over the part of an edge with lo <= v <= hi."""
    a, b = (F.least(F.greatest(F.col(c), lo), hi) for c in ("av", "bv"))
    at = lambda v: F.col("au") + (v - F.col("av")) / (F.col("bv") - F.col("av")) * (F.col("bu") - F.col("au"))
    return F.when(a != b, (at(a) + at(b)) / 2 * (b - a)).otherwise(F.lit(0.0))


def strip_areas(edges: DataFrame, width: float, phase: float = 0.0, field: str = "field_id") -> DataFrame:
    """(field, strip, area) of the parts of a polygon between v = phase + strip * width and the next such line."""
    lo, hi = F.least("av", "bv"), F.greatest("av", "bv")
    level = edges.where(lo < hi).select(field, "au", "av", "bu", "bv", F.explode(F.sequence(F.floor((lo - phase) / width), F.ceil((hi - phase) / width) - 1)).alias("strip"))
    return level.groupBy(field, "strip").agg(F.sum(_integral(phase + F.col("strip") * width, phase + (F.col("strip") + 1) * width)).alias("area"))


def half_plane_areas(edges: DataFrame, cuts: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, cut, below, above) for cuts (field, cut, level): areas on both sides of the line v = level."""
    far = F.lit(float("1e300"))
    met = edges.join(cuts, field)
    return met.groupBy(field, "cut").agg(F.sum(_integral(-far, F.col("level"))).alias("below"), F.sum(_integral(F.col("level"), far)).alias("above"))


def reflex_rays(edges: DataFrame, least_deg: float = 25.0, field: str = "field_id", ring: str = "ring") -> DataFrame:
    """(field, ring, i, side, x, y, dx, dy): at each vertex that turns right by more than `least_deg`, both edges drawn on into the polygon."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steps = edges.select(field, ring, "i", "ax", "ay", "bx", "by", dx.alias("dx"), dy.alias("dy"))
    # an edge that was turned round is followed by the one before it: neighbours are found by their common vertex
    after = steps.select(field, ring, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("dx").alias("nx"), F.col("dy").alias("ny"))
    met = steps.join(after, [field, ring, "bx", "by"])
    turn = vector_angle_deg(F.col("dx"), F.col("dy"), F.col("nx"), F.col("ny"))
    met = met.where((F.col("dx") * F.col("ny") - F.col("dy") * F.col("nx") < 0) & (turn > least_deg))
    sides = F.explode(F.array(F.struct(F.lit("IN").alias("side"), F.col("dx"), F.col("dy")), F.struct(F.lit("OUT").alias("side"), (-F.col("nx")).alias("dx"), (-F.col("ny")).alias("dy")))).alias("r")
    rays = met.select(field, ring, F.col("bx").alias("x"), F.col("by").alias("y"), sides)
    return rays.select(field, ring, "x", "y", "r.side", *((F.col(f"r.{c}") / F.hypot("r.dx", "r.dy")).alias(c) for c in ("dx", "dy")))


def first_hits(rays: DataFrame, edges: DataFrame, keys: list[str], field: str = "field_id", epsilon: float = 1e-6) -> DataFrame:
    """(keys, reach): how far each ray (x, y, unit dx, dy) goes until it first meets an edge of its field."""
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    px, py = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    cross = F.col("dx") * ey - F.col("dy") * ex
    met = rays.join(edges.select(field, "ax", "ay", "bx", "by"), field).where(F.abs(cross) > 1e-9 * F.hypot(ex, ey))
    met = met.select(*keys, ((px * ey - py * ex) / cross).alias("reach"), ((px * F.col("dy") - py * F.col("dx")) / cross).alias("share"))
    return met.where((F.col("reach") > epsilon) & (F.col("share") >= -1e-9) & (F.col("share") <= 1 + 1e-9)).groupBy(*keys).agg(F.min("reach").alias("reach"))


def points_inside(points: DataFrame, edges: DataFrame, keys: list[str], field: str = "field_id") -> DataFrame:
    """(keys, inside) of points (field, x, y) by the even-odd rule; points of fields without edges are outside."""
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    return points.join(edges.select(field, "ax", "ay", "bx", "by"), field, "left").groupBy(*keys).agg((F.count_if(crosses) % 2 == 1).alias("inside"))


def edge_contacts(edges: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, n_crossings, n_overlaps, n_touches): pairs of a field's edges that cross, run along each other, or, being of
    one ring and no neighbours in it, share a point.

    edges: with ring, i, and part where there are several. They are dealt to square cells along their way, and only edges
    of a cell meet. Coordinates are compared in units of `overlay.UNIT`.
    """
    edges = edges if "part" in edges.columns else edges.withColumn("part", F.lit(0))
    ring = Window.partitionBy(field, "part", "ring")
    place = edges.select(field, F.struct("part", "ring").alias("of"), F.row_number().over(ring.orderBy("i")).alias("k"), F.count("*").over(ring).alias("n"), *(F.round(F.col(c) / O.UNIT).alias(c) for c in O.ENDS))
    place = place.where("ax <> bx or ay <> by")
    cells = O.dealt(place.join(O.cell_widths(place, [field]), field))
    one = cells.select(field, "cx", "cy", "of", "k", "n", *O.ENDS)
    other = cells.select(field, "cx", "cy", F.col("of").alias("of2"), F.col("k").alias("k2"), *(F.col(c).alias(d) for c, d in zip(O.ENDS, ("px", "py", "qx", "qy"), strict=True)))
    near = (F.greatest("ax", "bx") >= F.least("px", "qx")) & (F.greatest("px", "qx") >= F.least("ax", "bx")) & (F.greatest("ay", "by") >= F.least("py", "qy")) & (F.greatest("py", "qy") >= F.least("ay", "by"))
    met = one.join(other, [field, "cx", "cy"]).where((F.struct("of", "k") < F.struct("of2", "k2")) & near)
    away = lambda a, b, p: ((F.col(f"{b}x") - F.col(f"{a}x")) * (F.col(f"{p}y") - F.col(f"{a}y")) - (F.col(f"{b}y") - F.col(f"{a}y")) * (F.col(f"{p}x") - F.col(f"{a}x"))) / F.hypot(F.col(f"{b}x") - F.col(f"{a}x"), F.col(f"{b}y") - F.col(f"{a}y"))
    d = {k: away(*k) for k in (("a", "b", "p"), ("a", "b", "q"), ("p", "q", "a"), ("p", "q", "b"))}
    p, q, a, b = d.values()
    far = lambda x: F.abs(x) > 1
    cross = (p * q < 0) & (a * b < 0) & far(p) & far(q) & far(a) & far(b)
    along = lambda v: ((F.col(f"{v}x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col(f"{v}y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    shared = F.least(F.greatest(along("p"), along("q")), length) - F.greatest(F.least(along("p"), along("q")), F.lit(0.0))
    overlap = ~far(p) & ~far(q) & (shared > 2)
    on = lambda x, v: ~far(x) & (along(v) >= -1) & (along(v) <= length + 1)
    back = lambda x, v: ~far(x) & (((F.col(f"{v}x") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col(f"{v}y") - F.col("py")) * (F.col("qy") - F.col("py"))).between(F.lit(0), F.pow(F.col("qx") - F.col("px"), 2) + F.pow(F.col("qy") - F.col("py"), 2)))
    neighbours = (F.col("k2") - F.col("k") == 1) | (F.col("k2") - F.col("k") == F.col("n") - 1)
    touch = (F.col("of") == F.col("of2")) & ~neighbours & (on(p, "p") | on(q, "q") | back(a, "a") | back(b, "b"))
    kind = F.when(cross, "CROSS").when(overlap, "OVERLAP").when(touch, "TOUCH")
    pairs = met.select(field, "of", "k", "of2", "k2", kind.alias("kind")).where("kind is not null").distinct()
    count = lambda k: F.count_if(F.col("kind") == k)
    return pairs.groupBy(field).agg(count("CROSS").alias("n_crossings"), count("OVERLAP").alias("n_overlaps"), count("TOUCH").alias("n_touches"))


def polygon_status(vertices: DataFrame, field: str = "field_id") -> DataFrame:
    """(field, status, area) of each polygon of one or several parts, each with holes.

    VALID, or the first of: NOT_FINITE, SELF_CROSSING, NO_AREA, EDGE_OVERLAP (edges that run along each other),
    RING_TOUCH (a ring that meets itself) and MISPLACED (a hole outside its shell or in another, parts that overlap).
    Rings may touch each other in points. area is that of the rings, holes taken off.
    """
    vertices = vertices if "part" in vertices.columns else vertices.withColumn("part", F.lit(0))
    edges = edges_of(vertices, (field, "part", "ring"))
    area = edges.groupBy(field).agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    broken = vertices.groupBy(field).agg(F.bool_or(~(finite_number(F.col("x").cast("double")) & finite_number(F.col("y").cast("double")))).alias("broken"))
    sides = O.arranged(edges.select(field, *O.ENDS), None, (field,))
    above = F.col("below_a") + F.col("n_a")
    placed = sides.groupBy(field).agg(F.bool_and(F.col("below_a").between(0, 1) & above.between(0, 1)).alias("placed"))
    met = broken.join(area, field, "left").join(edge_contacts(edges, field), field, "left").join(placed, field, "left")
    status = (
        F.when(F.col("broken"), "NOT_FINITE").when(F.col("n_crossings") > 0, "SELF_CROSSING").when(F.coalesce("area", F.lit(0.0)) <= 0, "NO_AREA")
        .when(F.col("n_overlaps") > 0, "EDGE_OVERLAP").when(F.col("n_touches") > 0, "RING_TOUCH").when(~F.coalesce("placed", F.lit(True)), "MISPLACED").otherwise("VALID")
    )
    return met.select(field, status.alias("status"), "area")


def without_spikes(vertices: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "i", relative: float = 1e-9) -> DataFrame:
    """Vertices without zero-area spikes: tips at which a ring turns right back, then points that repeat."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = {c: F.col(c) - F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in "xy"}
    on = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) - F.col(c) for c in "xy"}
    steps = vertices.withColumns({"ux": back["x"], "uy": back["y"], "vx": on["x"], "vy": on["y"]})
    cross, dot, size = F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx"), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy"), F.hypot("ux", "uy") * F.hypot("vx", "vy")
    kept = steps.where(~((F.abs(cross) <= relative * size) & (dot < 0))).select(*vertices.columns)
    again = kept.withColumns({"ux": back["x"], "uy": back["y"]})
    return again.where(F.hypot("ux", "uy") > relative).select(*vertices.columns)
