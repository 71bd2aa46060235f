"""Routing inside a field: direction choice as a fold, and searches as grouped functions.

A field is the unit of work; its size is bounded by the field, never by the batch. Ordered greedy steps, which no
unordered aggregate can express, run in one group a field, in the documented order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.columns import dubins_length
from furrow.functions.polygons import grid_path, least_rectangle


def direction_costs(tasks: DataFrame, field: str = "field_id", order: str = "task") -> DataFrame:
    """Least travel over all choices of direction of tasks in a fixed order (columns x0, x1, y): a two-state fold."""
    ordered = tasks.groupBy(field).agg(F.array_sort(F.collect_list(F.struct(order, "x0", "x1", "y"))).alias("t"))
    far = lambda x, y, t, start: F.hypot(t[start] - x, t["y"] - y)
    state = lambda f, r, t: F.struct(f.alias("f"), r.alias("r"), t["x0"].alias("x0"), t["x1"].alias("x1"), t["y"].alias("y"))
    first = F.get("t", F.lit(0))
    # f: the last task ends at x1; r: it ends at x0
    step = lambda s, t: state(F.least(s["f"] + far(s["x1"], s["y"], t, "x0"), s["r"] + far(s["x0"], s["y"], t, "x0")), F.least(s["f"] + far(s["x1"], s["y"], t, "x1"), s["r"] + far(s["x0"], s["y"], t, "x1")), t)
    fold = F.aggregate(F.slice("t", 2, F.size("t")), state(F.lit(0.0), F.lit(0.0), first), step, lambda s: F.least(s["f"], s["r"]))
    return ordered.select(field, F.size("t").alias("n_tasks"), fold.alias("travel"))


def region_tours(regions: DataFrame) -> DataFrame:
    """(field_id, region_id, place): from the region nearest to the origin, always to the nearest one left; neighbours first."""

    def tour(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {r.region_id: r for r in pdf.sort_values("region_id").itertuples()}
        mid = {k: ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for k, r in left.items()}
        touch = lambda a, b: left[a].x0 <= left[b].x1 and left[b].x0 <= left[a].x1 and left[a].y0 <= left[b].y1 and left[b].y0 <= left[a].y1
        at, out, todo = None, [], set(left)
        while todo:
            here = (0.0, 0.0) if at is None else mid[at]
            at = min(todo, key=lambda k: (at is not None and not touch(at, k), round(abs(mid[k][0] - here[0]) + abs(mid[k][1] - here[1]), 6), k))
            todo.remove(at)
            out.append((pdf.field_id.iloc[0], at, len(out) + 1))
        return pd.DataFrame(out, columns=["field_id", "region_id", "place"])

    return regions.select("field_id", "region_id", "x0", "y0", "x1", "y1").groupBy("field_id").applyInPandas(tour, "field_id long, region_id int, place int")


def grid_detours(fields: DataFrame, cell: float = 5.0) -> DataFrame:
    """(field_id, status, length): path from the left to the right edge at mid-height, on free cells of the field."""

    def detour(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in pdf.itertuples():
            x, y = (np.arange(0, f.w, cell) + cell / 2)[None, :], (np.arange(0, f.h, cell) + cell / 2)[:, None]
            free = (x <= f.w) & (y <= f.h)
            if f.kind == 1:
                free &= ~((x > f.w // 2) & (y > f.h // 2))
            if f.kind == 2:
                free &= ~((x > f.w // 3) & (x < 2 * (f.w // 3)) & (y > f.h // 3) & (y < 2 * (f.h // 3)))
            row = free.shape[0] // 2
            status, length, _ = grid_path(free, (row, 0), (row, free.shape[1] - 1))
            out.append((f.field_id, status, None if status != "FOUND" else round(length * cell, 4)))
        return pd.DataFrame(out, columns=["field_id", "status", "length"])

    return fields.select("field_id", "kind", "w", "h").mapInPandas(lambda it: map(detour, it), "field_id long, status string, length double")


def forward_turns(tasks: DataFrame, radius: float = 5.0) -> DataFrame:
    """(field_id, task, length): shortest forward turn from the end of each task to the start of the next (xs, xe, y)."""
    w = Window.partitionBy("field_id").orderBy("task")
    yaw = F.when(F.col("xe") >= F.col("xs"), 0.0).otherwise(math.pi)
    steps = tasks.select("field_id", "task", "xe", "y", yaw.alias("yaw"), F.lead("xs").over(w).alias("nx"), F.lead("y").over(w).alias("ny"), F.lead(yaw).over(w).alias("nyaw")).where("nx is not null")
    return steps.select("field_id", "task", dubins_length(F.col("nx") - F.col("xe"), F.col("ny") - F.col("y"), F.col("yaw"), F.col("nyaw"), radius).alias("length"))


def gap_cover(candidates: DataFrame, least_gain: float) -> DataFrame:
    """(field_id, candidate, gain, place): greedy cover of cells (field_id, candidate, cell); ties to the smaller candidate."""

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {k: set(g) for k, g in pdf.groupby("candidate").cell}
        out = []
        while left:
            best = min(left, key=lambda k: (-len(left[k]), k))
            gain = left.pop(best)
            if len(gain) < least_gain:
                break
            out.append((pdf.field_id.iloc[0], best, len(gain), len(out) + 1))
            left = {k: s - gain for k, s in left.items()}
        return pd.DataFrame(out, columns=["field_id", "candidate", "gain", "place"])

    return candidates.select("field_id", "candidate", "cell").groupBy("field_id").applyInPandas(cover, "field_id long, candidate int, gain int, place int")


def cross_region_needs(needs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(field_id, cell, task): each needed cell (field_id, cell, region_id) to its own region's first task that covers it, else to the first of another."""
    own = needs.join(tasks.select("field_id", "cell", F.col("region_id").alias("by_region"), "task"), ["field_id", "cell"], "left")
    best = F.min(F.when(F.col("task").isNotNull(), F.struct((F.col("by_region") != F.col("region_id")).cast("int").alias("foreign"), "task"))).alias("m")
    return own.groupBy("field_id", "cell").agg(best).select("field_id", "cell", "m.foreign", "m.task")


def least_rectangles(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Sides and long-axis angle of the least rectangle around each group's points."""
    schema = vertices.select(*keys).schema

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, angle = least_rectangle(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame([[*pdf[keys].iloc[0], round(a, 4), round(b, 4), round(angle, 4)]], columns=[*keys, "long_m", "short_m", "axis_deg"])

    out = T.StructType([*schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("long_m", "short_m", "axis_deg"))])
    return vertices.select(*keys, "x", "y").groupBy(*keys).applyInPandas(box, out)


def union_areas(boxes: DataFrame, field: str = "field_id") -> DataFrame:
    """Union area of each group's boxes (x0, y0, x1, y1): between neighbouring edges in x, the union of intervals in y."""
    edges = boxes.select(field, F.explode(F.array(F.col("x0").cast("double"), F.col("x1").cast("double"))).alias("x")).distinct()
    slabs = edges.withColumn("to", F.lead("x").over(Window.partitionBy(field).orderBy("x"))).where("to is not null")
    met = slabs.join(boxes.select(field, "x0", "x1", "y0", "y1"), field).where("x0 <= x and x1 >= to and y1 > y0")
    w = Window.partitionBy(field, "x").orderBy("y0", "y1")
    reached = F.coalesce(F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("y0"))
    met = met.select(field, "x", "to", (F.greatest(F.col("y1") - F.greatest(F.col("y0"), reached), F.lit(0)) * (F.col("to") - F.col("x"))).alias("area"))
    return boxes.select(field).distinct().join(met.groupBy(field).agg(F.sum("area").alias("union_area")), field, "left").select(field, F.coalesce("union_area", F.lit(0.0)).alias("union_area"))


def distinct_directions(proposals: DataFrame, least_deg: float = 3.0, most: int = 8) -> DataFrame:
    """(field_id, angle, place): by falling weight, angles at least `least_deg` from all taken before, at most `most`.

    A fold over the sorted proposals of a field, of which equal angles are one.
    """
    best = proposals.groupBy("field_id", F.col("angle").cast("double").alias("angle")).agg(F.max("weight").alias("weight"))
    ordered = best.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "angle"))).alias("p"))
    far = lambda taken, a: F.forall(taken, lambda b: angle_gap(a, b) >= least_deg)
    fold = F.aggregate("p", F.array().cast("array<double>"), lambda taken, p: F.when((F.size(taken) < most) & far(taken, p["angle"]), F.concat(taken, F.array(p["angle"]))).otherwise(taken))
    return ordered.select("field_id", F.posexplode(fold).alias("place", "angle")).select("field_id", "angle", (F.col("place") + 1).alias("place"))


def angle_gap(a, b):
    return F.least(F.pmod(a - b, F.lit(180.0)), F.pmod(b - a, F.lit(180.0)))
