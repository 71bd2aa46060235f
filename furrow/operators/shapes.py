"""Shape metrics of rings and polylines as windows and sums over vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import compactness, vector_angle_deg


def _around(keys: list[str], order: str):
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    prv = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    return nxt, prv


def ring_metrics(vertices: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Signed area, perimeter and vertex count of each ring (x, y in order, not closed)."""
    nxt, _ = _around(keys, order)
    df = vertices.select(*keys, "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"))
    return df.groupBy(*keys).agg(
        (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("signed_area"),
        F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("perimeter"),
        F.count("*").alias("n_vertices"),
    )


def polygon_metrics(rings: DataFrame, field: str = "field_id", ring: str = "ring") -> DataFrame:
    """Net and gross area, perimeters, holes, compactness of polygons from `ring_metrics`; ring 0 is the outside."""
    outer = F.col(ring) == 0
    area = F.abs("signed_area")
    out = rings.groupBy(field).agg(
        F.sum(F.when(outer, area).otherwise(-area)).alias("net_area"), F.sum(F.when(outer, area)).alias("gross_area"),
        F.sum(F.when(outer, F.col("perimeter"))).alias("outer_perimeter"), F.sum("perimeter").alias("perimeter"), F.count_if(~outer).alias("holes"),
    )
    return out.withColumn("compactness", compactness(F.col("gross_area"), F.col("outer_perimeter")))


def reflex_vertices(vertices: DataFrame, keys: list[str], order: str = "i", least_deg: float = 25.0) -> DataFrame:
    """Vertices of counter-clockwise rings that turn right by more than `least_deg`."""
    nxt, prv = _around(keys, order)
    df = vertices.select(*keys, order, "x", "y", (F.col("x") - prv("x")).alias("ux"), (F.col("y") - prv("y")).alias("uy"), (nxt("x") - F.col("x")).alias("vx"), (nxt("y") - F.col("y")).alias("vy"))
    turn = vector_angle_deg(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    return df.where((F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx") < 0) & (turn > least_deg)).select(*keys, order, "x", "y", turn.alias("turn_deg"))


def turning_angles(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Angle at each inner vertex of a polyline."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = points.select(*keys, order, *((F.col(c) - F.lag(c).over(w)).alias(f"u{c}") for c in "xy"), *((F.lead(c).over(w) - F.col(c)).alias(f"v{c}") for c in "xy"))
    return df.where("ux is not null and vx is not null").select(*keys, order, vector_angle_deg(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")).alias("angle_deg"))
