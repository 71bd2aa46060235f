"""Queries over the library's DataFrame operators, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import graph, routing, shapes
from furrow.operators import time_ledger as T
from furrow.plans.shared import SHARED
from furrow.plans.views import run, table, view

FRAMED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        FRAMED[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


_W = "WINDOW w AS (PARTITION BY chain ORDER BY sequence), up AS (PARTITION BY chain ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY chain ORDER BY sequence ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_ENVELOPE = f"""e0 AS (SELECT *, coalesce(CASE WHEN lag(working) OVER w = working THEN lag(cap) OVER w END, 0) AS pc, coalesce(CASE WHEN lead(working) OVER w = working THEN lead(cap) OVER w END, 0) AS nc FROM {{v_legs}} {_W}),
e1 AS (SELECT *, CASE WHEN cap > pc THEN cap - pc ELSE cap END / 2 AS accel, CASE WHEN cap > nc THEN cap - nc ELSE cap END / 2 AS decel, least(pc, cap) * least(pc, cap) AS b0, least(nc, cap) * least(nc, cap) AS b1 FROM e0),
e2 AS (SELECT *, sum(2 * accel * length) OVER up AS s1, sum(2 * decel * length) OVER down AS t0 FROM e1 {_W}),
e3 AS (SELECT *, s1 - 2 * accel * length AS s0, t0 - 2 * decel * length AS t1 FROM e2),
e4 AS (SELECT *, min(b0 - s0) OVER up AS f, min(b1 - t1) OVER down AS g FROM e3 {_W}),
e5 AS (SELECT *, sqrt(greatest(least(s0 + f, t0 + g), 0)) AS v0, sqrt(greatest(least(b1, s1 + f, t1 + g), 0)) AS v1 FROM e4),
env AS (SELECT *, greatest(least(cap, sqrt(greatest((2 * accel * decel * length + decel * v0 * v0 + accel * v1 * v1) / (accel + decel), 0))), v0, v1) AS peak FROM e5),
p0 AS (SELECT *, greatest((peak * peak - v0 * v0) / (2 * accel), 0) AS up_m, greatest((peak * peak - v1 * v1) / (2 * decel), 0) AS down_m FROM env),
ph AS (SELECT * FROM (SELECT chain, sequence, field_id, working, category, cap, length, 0 AS phase_no, 'ACCEL' AS phase, up_m AS distance, v0 AS entry, peak AS leave FROM p0
  UNION ALL SELECT chain, sequence, field_id, working, category, cap, length, 1, 'CRUISE', greatest(length - up_m - down_m, 0), peak, peak FROM p0
  UNION ALL SELECT chain, sequence, field_id, working, category, cap, length, 2, 'DECEL', down_m, peak, v1 FROM p0) q WHERE distance > 1E-10),
ps AS (SELECT *, 2 * distance / (entry + leave) AS seconds FROM ph),
st AS (SELECT chain, count(*) FILTER (WHERE starts) + count(*) FILTER (WHERE stops) AS n FROM (SELECT chain, working AND NOT coalesce(lag(working) OVER w, false) AS starts, working AND NOT coalesce(lead(working) OVER w, false) AS stops FROM {{v_legs}} {_W}) q GROUP BY chain),
mt AS (SELECT chain, count(*) AS n_stops FROM (SELECT DISTINCT chain, p FROM (SELECT chain, s1 AS p FROM (SELECT chain, sum(length) OVER up - length AS s1, working AND NOT coalesce(lag(working) OVER w, false) AS x FROM {{v_legs}} {_W}) a WHERE x UNION ALL
  SELECT chain, e1 FROM (SELECT chain, sum(length) OVER up AS e1, working AND NOT coalesce(lead(working) OVER w, false) AS x FROM {{v_legs}} {_W}) b WHERE x) c) d GROUP BY chain),
ti AS (SELECT chain, sum(CASE WHEN working THEN seconds ELSE 0 END) AS t_work, sum(CASE WHEN working THEN 0 ELSE seconds END) AS t_drive, count(DISTINCT sequence) AS n FROM ps GROUP BY chain),
ef AS (SELECT ti.chain, t_work, t_drive, coalesce(n_stops, 0) * 1.0E0 AS t_stop, CASE WHEN n > 1 THEN 0 ELSE 1 END AS issues FROM ti LEFT JOIN mt ON mt.chain = ti.chain)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_legs")


def chain_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of each chain; a chain of one leg counts as incomplete."""
    rows = legs(spark, sf_dir)
    times = T.phases(T.speed_envelope(rows, ["chain"], "sequence")).groupBy("chain").agg(
        F.sum(F.when(F.col("working"), F.col("seconds")).otherwise(0.0)).alias("t_work"), F.sum(F.when(F.col("working"), 0.0).otherwise(F.col("seconds"))).alias("t_drive"), F.countDistinct("sequence").alias("n")
    )
    stops = T.merged_stops(T.switch_stops(T.with_progress(rows, ["chain"], "sequence"), ["chain"], "sequence"), ["chain"]).groupBy("chain").agg(F.sum("stop_seconds").alias("t_stop"))
    times = times.join(stops, "chain", "left").withColumns({"t_stop": F.coalesce("t_stop", F.lit(0.0)), "issues": F.when(F.col("n") > 1, 0).otherwise(1)})
    return T.efficiency(times, ["chain"])


@query(f"WITH {_ENVELOPE} SELECT chain, round(t_work, 4) AS t_work, round(t_drive, 4) AS t_drive, round(t_stop, 4) AS t_stop, CASE WHEN issues = 0 THEN round(t_work / (t_work + t_drive + t_stop), 4) END AS ratio, CASE WHEN issues = 0 THEN 'ESTIMATED' ELSE 'INCOMPLETE' END AS status FROM ef")
def tim_efficiency_by_chain(spark, sf_dir):
    return rounded(chain_times(spark, sf_dir), "t_work", "t_drive", "t_stop", "ratio")


@query(f"WITH {_ENVELOPE} SELECT count(*) AS n_fields, count(*) FILTER (WHERE issues = 0) AS n_estimated, round(sum(t_work), 1) AS t_work, round(sum(t_work + t_drive + t_stop), 1) AS t_total, CASE WHEN bool_and(issues = 0) THEN round(sum(t_work) / sum(t_work + t_drive + t_stop), 4) END AS ratio FROM ef")
def agg_batch_ratio_of_sums(spark, sf_dir):
    return T.batch_ratio(chain_times(spark, sf_dir)).withColumns({"t_work": F.round("t_work", 1), "t_total": F.round("t_total", 1), "ratio": F.round("ratio", 4)})


@query(f"WITH {_ENVELOPE} SELECT chain, sequence, round(v0, 4) AS v0, round(v1, 4) AS v1, round(peak, 4) AS peak FROM env")
def win_speed_envelope(spark, sf_dir):
    return rounded(T.speed_envelope(legs(spark, sf_dir), ["chain"], "sequence").select("chain", "sequence", "v0", "v1", "peak"), "v0", "v1", "peak")


@query(f"WITH {_ENVELOPE} SELECT chain, phase, count(*) AS n, round(sum(distance), 4) AS distance, round(sum(seconds), 4) AS seconds FROM ps GROUP BY chain, phase")
def tim_phases(spark, sf_dir):
    p = T.phases(T.speed_envelope(legs(spark, sf_dir), ["chain"], "sequence"))
    return rounded(p.groupBy("chain", "phase").agg(F.count("*").alias("n"), F.sum("distance").alias("distance"), F.sum("seconds").alias("seconds")), "distance", "seconds")


@query(f"""WITH {_ENVELOPE}, q1 AS (SELECT *, sum(distance) OVER (PARTITION BY chain ORDER BY sequence, phase_no) AS e FROM ps), q2 AS (SELECT *, CASE WHEN lag(phase) OVER v = phase AND abs(lag(e) OVER v - (e - distance)) < 1E-8 THEN 0 ELSE 1 END AS fresh FROM q1 WHERE phase <> 'CRUISE' WINDOW v AS (PARTITION BY chain ORDER BY sequence, phase_no)),
q3 AS (SELECT *, sum(fresh) OVER (PARTITION BY chain ORDER BY sequence, phase_no) AS event_no FROM q2)
SELECT chain, CAST(event_no AS BIGINT) AS event_no, phase, round(sum(distance), 4) AS distance, round(sum(seconds), 4) AS seconds FROM q3 GROUP BY chain, event_no, phase""")
def tim_moving_events(spark, sf_dir):
    e = T.moving_events(T.phases(T.speed_envelope(legs(spark, sf_dir), ["chain"], "sequence")), ["chain"], "sequence")
    return rounded(e.select("chain", "event_no", "phase", "distance", "seconds"), "distance", "seconds")


@query(f"WITH {_ENVELOPE} SELECT chain, round(sum(seconds) - max(plain), 3) AS extra_s FROM (SELECT p.chain, p.seconds, l.plain FROM ps p JOIN (SELECT chain, sum(length / cap) AS plain FROM {{v_legs}} GROUP BY chain) l ON l.chain = p.chain) q GROUP BY chain")
def tim_speed_extra(spark, sf_dir):
    p = T.phases(T.speed_envelope(legs(spark, sf_dir), ["chain"], "sequence"))
    block = p.groupBy("chain", "sequence").agg(F.sum("seconds").alias("s"), (F.first("length") / F.first("cap")).alias("plain"))
    return block.groupBy("chain").agg(F.round(F.sum("s") - F.sum("plain"), 3).alias("extra_s"))


@query("""SELECT chain, count(*) AS n_stops, round(sum(s), 4) AS stop_s, round(sum(u), 4) AS unmerged_s FROM (SELECT chain, p, max(1.0E0) AS s, sum(1.0E0) AS u FROM (
  SELECT chain, e - length AS p, working AND NOT coalesce(lag(working) OVER (PARTITION BY chain ORDER BY sequence), false) AS x FROM (SELECT *, sum(length) OVER (PARTITION BY chain ORDER BY sequence) AS e FROM {v_legs}) a
  UNION ALL SELECT chain, e, working AND NOT coalesce(lead(working) OVER (PARTITION BY chain ORDER BY sequence), false) FROM (SELECT *, sum(length) OVER (PARTITION BY chain ORDER BY sequence) AS e FROM {v_legs}) b) c WHERE x GROUP BY chain, p) d GROUP BY chain""")
def tim_merged_stops(spark, sf_dir):
    stops = T.merged_stops(T.switch_stops(T.with_progress(legs(spark, sf_dir), ["chain"], "sequence"), ["chain"], "sequence"), ["chain"])
    return stops.groupBy("chain").agg(F.count("*").alias("n_stops"), F.round(F.sum("stop_seconds"), 4).alias("stop_s"), F.round(F.sum("unmerged_seconds"), 4).alias("unmerged_s"))


@query("""SELECT chain, sequence, CAST(sum(b) OVER (PARTITION BY chain ORDER BY sequence) AS BIGINT) AS part FROM (SELECT chain, sequence, CASE WHEN lag(category) OVER (PARTITION BY chain ORDER BY sequence) = category THEN 0 ELSE 1 END AS b FROM {v_legs}) q""")
def tim_chain_numbers(spark, sf_dir):
    rows = legs(spark, sf_dir)
    rows = rows.withColumn("prev_category", F.lag("category").over(Window.partitionBy("chain").orderBy("sequence")))
    return T.chain_numbers(rows, ["chain"], "sequence", F.col("prev_category") != F.col("category"), "part").select("chain", "sequence", F.col("part").cast("long"))


@query("""SELECT chain, category, round(sum(length), 4) AS distance_m, count(*) AS n FROM {v_legs} GROUP BY chain, category""")
def tim_breakdown(spark, sf_dir):
    by = legs(spark, sf_dir).groupBy("chain", "category").agg(F.struct(F.round(F.sum("length"), 4).alias("distance_m"), F.count("*").alias("n")).alias("v"))
    maps = by.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct("category", "v"))).alias("breakdown"))
    return maps.select("chain", F.explode("breakdown").alias("category", "v")).select("chain", "category", "v.distance_m", "v.n")


@query("""WITH n AS (SELECT field_id, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM {v_rings} WINDOW w AS (PARTITION BY field_id, ring ORDER BY i))
SELECT field_id, ring, round(sum(x * ny - nx * y) / 2.0E0, 4) AS signed_area, round(sum(abs(nx - x) + abs(ny - y)), 4) AS perimeter, count(*) AS n_vertices FROM n GROUP BY field_id, ring""")
def geo_ring_area_perimeter(spark, sf_dir):
    m = shapes.ring_metrics(view(spark, sf_dir, "v_rings"), ["field_id", "ring"])
    return m.withColumns({"signed_area": F.round("signed_area", 4), "perimeter": F.round(F.col("perimeter"), 4).cast("bigint")})


ORACLES["geo_ring_area_perimeter"] = ORACLES["geo_ring_area_perimeter"].replace("round(sum(abs(nx - x) + abs(ny - y)), 4) AS perimeter", "CAST(sum(abs(nx - x) + abs(ny - y)) AS BIGINT) AS perimeter")


@query("""SELECT field_id, CAST(w * h - CASE kind WHEN 0 THEN 0 WHEN 1 THEN (w - floor(w / 2)) * (h - floor(h / 2)) ELSE floor(w / 3) * floor(h / 3) END AS DOUBLE) AS net_area, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS holes,
round(4 * pi() * (w * h - CASE kind WHEN 1 THEN (w - floor(w / 2)) * (h - floor(h / 2)) ELSE 0 END) / (4.0E0 * (w + h) * (w + h)), 4) AS compactness FROM {v_fields}""")
def geo_compactness(spark, sf_dir):
    m = shapes.polygon_metrics(shapes.ring_metrics(view(spark, sf_dir, "v_rings"), ["field_id", "ring"]))
    return m.select("field_id", "net_area", F.col("holes").cast("int").alias("holes"), F.round("compactness", 4).alias("compactness"))


@query("""SELECT field_id, 0 AS ring, 3 AS i, CAST(floor(w / 2) AS INT) AS x, CAST(floor(h / 2) AS INT) AS y, 90.0E0 AS turn_deg FROM {v_fields} WHERE kind = 1""")
def geo_reflex_vertices(spark, sf_dir):
    outer = view(spark, sf_dir, "v_rings").where("ring = 0")
    return rounded(shapes.reflex_vertices(outer, ["field_id", "ring"]), "turn_deg")


@query("""SELECT chain, i, round(CASE WHEN n > 0 THEN degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / n)))) ELSE 0 END, 3) AS angle_deg FROM (SELECT *, sqrt((ux * ux + uy * uy)) * sqrt((vx * vx + vy * vy)) AS n FROM (
  SELECT chain, i, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, (lead(x) OVER w) - x AS vx, (lead(y) OVER w) - y AS vy FROM {v_track} WINDOW w AS (PARTITION BY chain ORDER BY i)) p WHERE ux IS NOT NULL AND vx IS NOT NULL) q""")
def kin_turn_angles(spark, sf_dir):
    a = shapes.turning_angles(view(spark, sf_dir, "v_track"), ["chain"], "i")
    return a.withColumn("angle_deg", F.round("angle_deg", 3))


@query("""SELECT chain, i, round(yaw * 2 + pi() - 2 * pi() * floor((yaw * 2 + pi()) / (2 * pi())) - pi(), 4) AS wrapped, round(least((x * 7) % 180, 180 - (x * 7) % 180), 4) AS undirected FROM {v_track}""")
def geo_angles(spark, sf_dir):
    t = view(spark, sf_dir, "v_track")
    return t.select("chain", "i", F.round(C.wrap_angle(F.col("yaw") * 2), 4).alias("wrapped"), F.round(C.angle_difference_deg(F.col("x") * 7, F.lit(0.0)), 4).alias("undirected"))


@query("""SELECT chain, i, round(x + 1.0E0 * cos(yaw) - 2.0E0 * sin(yaw), 4) AS px, round(y + 1.0E0 * sin(yaw) + 2.0E0 * cos(yaw), 4) AS py FROM {v_track}""")
def geo_pose_vertices(spark, sf_dir):
    t = view(spark, sf_dir, "v_track")
    px, py = C.to_world(F.lit(1.0), F.lit(2.0), F.col("x"), F.col("y"), F.col("yaw"))
    return t.select("chain", "i", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * _N**0.5 / (1 + _N)
_SERIES = {way: " + ".join([start, *(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))]) for way, start, f, g in (("east", "eta", "cos", "sinh"), ("north", "xi", "sin", "cosh"))}


@query(f"""WITH q AS (SELECT s_suppkey, (s_suppkey * 37) % 360 - 180.0E0 AS lon, (s_suppkey * 53) % 160 - 80.0E0 AS lat FROM {{supplier}}), z AS (SELECT *, CAST(floor((lon + 180) / 6) AS INT) + 1 AS zone FROM q),
r AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {_E!r} * atanh({_E!r} * sin(radians(lat)))) AS t FROM z),
c AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM r)
SELECT s_suppkey, lon, lat, zone, round(500000 + {_RADIUS!r} * ({_SERIES["east"]}), 3) AS east, round({_RADIUS!r} * ({_SERIES["north"]}), 3) AS north FROM c""")
def geo_utm_points(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 360 - 180.0).alias("lon"), ((F.col("s_suppkey") * 53) % 160 - 80.0).alias("lat"))
    e, n = C.utm(F.col("lon"), F.col("lat"))
    return t.select("s_suppkey", "lon", "lat", C.utm_zone(F.col("lon")).alias("zone"), F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


_ALONG = "greatest(0, w * {x}, w * {x} + h2 * {y}, w2 * {x} + h * {y}, h * {y}) - least(0, w * {x}, w * {x} + h2 * {y}, w2 * {x} + h * {y}, h * {y})"


@query(f"""WITH p AS (SELECT field_id, kind, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, floor(w / 2) * 1.0E0 AS w2, floor(h / 2) * 1.0E0 AS h2 FROM {{v_fields}}),
u AS (SELECT *, (w2 - w) / sqrt((w2 - w) * (w2 - w) + (h - h2) * (h - h2)) AS ux, (h - h2) / sqrt((w2 - w) * (w2 - w) + (h - h2) * (h - h2)) AS uy FROM p),
s AS (SELECT *, {_ALONG.format(x="ux", y="uy")} AS du, {_ALONG.format(x="(-uy)", y="ux")} AS dn FROM u),
t AS (SELECT *, kind = 1 AND du * dn < w * h - 1E-9 AS slanted FROM s)
SELECT field_id, round(CASE WHEN slanted THEN greatest(du, dn) ELSE greatest(w, h) END, 4) AS long_m, round(CASE WHEN slanted THEN least(du, dn) ELSE least(w, h) END, 4) AS short_m,
round(CASE WHEN NOT slanted THEN CASE WHEN h > w THEN 90.0E0 ELSE 0.0E0 END WHEN du >= dn THEN degrees(atan2(uy, ux)) ELSE degrees(atan2(uy, ux)) - 90 END, 4) AS axis_deg FROM t""")
def geo_least_rectangles(spark, sf_dir):
    return routing.least_rectangles(view(spark, sf_dir, "v_rings"), ["field_id"])


@query("""SELECT field_id, CAST(w * h - CASE kind WHEN 0 THEN 0 WHEN 1 THEN (w - floor(w / 2)) * (h - floor(h / 2)) ELSE floor(w / 3) * floor(h / 3) + (h - 3 * floor(h / 3)) * 0 + (w - 3 * floor(w / 3)) * 0 END AS DOUBLE) AS union_area FROM {v_fields}""")
def agg_union_area_sweep(spark, sf_dir):
    return routing.union_areas(view(spark, sf_dir, "v_regions"))


_LINKS = SHARED["joi_row_links_degree1"]


@query(f"""WITH RECURSIVE_HERE l0 AS ({_LINKS.replace("WITH l AS", "WITH l AS", 1)}),
lk AS (SELECT field_id, row_index * 10 + piece_a AS a, (row_index + 1) * 10 + piece_b AS b FROM l0),
nodes AS (SELECT field_id, row_index * 10 + piece AS node FROM {{v_segments}}),
walk AS (SELECT n.field_id, n.node, n.node AS root FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.field_id = n.field_id AND lk.b = n.node)
  UNION ALL SELECT lk.field_id, lk.b, walk.root FROM walk JOIN lk ON lk.field_id = walk.field_id AND lk.a = walk.node)
SELECT field_id, CAST(node AS INT) AS task, CAST(root AS INT) AS block FROM walk""")
def joi_execution_blocks(spark, sf_dir):
    links = run(spark, sf_dir, _LINKS).select(F.struct("field_id", (F.col("row_index") * 10 + F.col("piece_a")).alias("n")).alias("a"), F.struct("field_id", ((F.col("row_index") + 1) * 10 + F.col("piece_b")).alias("n")).alias("b"))
    nodes = view(spark, sf_dir, "v_segments").select(F.struct("field_id", (F.col("row_index") * 10 + F.col("piece")).alias("n")).alias("node"))
    return graph.components(nodes, links).select("node.field_id", F.col("node.n").alias("task"), F.col("component.n").alias("block"))


@query("""SELECT field_id, region_id, 1 AS component FROM {v_regions}""")
def par_passable_components(spark, sf_dir):
    g = view(spark, sf_dir, "v_regions")
    edges = run(spark, sf_dir, SHARED["par_adjacency"]).where("length > 0").select(F.struct("field_id", F.col("region_a").alias("r")).alias("a"), F.struct("field_id", F.col("region_b").alias("r")).alias("b"))
    c = graph.components(g.select(F.struct("field_id", F.col("region_id").alias("r")).alias("node")), edges)
    return c.select("node.field_id", F.col("node.r").alias("region_id"), F.col("component.r").alias("component"))


@query("""WITH RECURSIVE_HERE t AS (SELECT field_id, task, x0, x1, y, count(*) OVER (PARTITION BY field_id) AS n FROM {v_ordered}),
dp AS (SELECT field_id, task, 0.0E0 AS f, 0.0E0 AS r, x0, x1, y, n FROM t WHERE task = 1
  UNION ALL SELECT t.field_id, t.task, least(dp.f + sqrt((t.x0 - dp.x1) ** 2 + (t.y - dp.y) ** 2), dp.r + sqrt((t.x0 - dp.x0) ** 2 + (t.y - dp.y) ** 2)), least(dp.f + sqrt((t.x1 - dp.x1) ** 2 + (t.y - dp.y) ** 2), dp.r + sqrt((t.x1 - dp.x0) ** 2 + (t.y - dp.y) ** 2)), t.x0, t.x1, t.y, t.n
  FROM dp JOIN t ON t.field_id = dp.field_id AND t.task = dp.task + 1)
SELECT field_id, CAST(n AS INT) AS n_tasks, round(least(f, r), 4) AS travel FROM dp WHERE task = n""")
def nav_direction_dp(spark, sf_dir):
    return rounded(routing.direction_costs(view(spark, sf_dir, "v_ordered")), "travel")


@query("""WITH RECURSIVE_HERE g AS (SELECT field_id, region_id, x0, y0, x1, y1, (x0 + x1) / 2.0E0 AS mx, (y0 + y1) / 2.0E0 AS my, count(*) OVER (PARTITION BY field_id) AS n FROM {v_regions}),
s AS (SELECT field_id, region_id, n, row_number() OVER (PARTITION BY field_id ORDER BY round(abs(mx) + abs(my), 6), region_id) AS r FROM g),
tour AS (SELECT field_id, region_id, [region_id] AS seen, 1 AS place, n FROM s WHERE r = 1
  UNION ALL SELECT t.field_id, b.region_id, list_append(t.seen, b.region_id), t.place + 1, t.n FROM tour t JOIN g a ON a.field_id = t.field_id AND a.region_id = t.region_id
  JOIN g b ON b.field_id = t.field_id AND NOT list_contains(t.seen, b.region_id) AND NOT EXISTS (SELECT 1 FROM g c WHERE c.field_id = t.field_id AND NOT list_contains(t.seen, c.region_id) AND
    (CASE WHEN a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1 THEN 0 ELSE 1 END, round(abs(c.mx - a.mx) + abs(c.my - a.my), 6), c.region_id) <
    (CASE WHEN a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 THEN 0 ELSE 1 END, round(abs(b.mx - a.mx) + abs(b.my - a.my), 6), b.region_id)))
SELECT field_id, CAST(region_id AS INT) AS region_id, CAST(place AS INT) AS place FROM tour""")
def nav_region_tour(spark, sf_dir):
    return routing.region_tours(view(spark, sf_dir, "v_regions"))


@query()
def nav_grid_astar(spark, sf_dir):
    return routing.grid_detours(view(spark, sf_dir, "v_fields"))


_FULL = "2 * pi()"


def _turned(x: str) -> str:
    """An angle in [0, 2 pi)."""
    return f"(({x}) - {_FULL} * floor(({x}) / ({_FULL})))"


_WORDS = [
    ("2 + d * d - 2 * cos(a - b) + 2 * d * (sin(a) - sin(b))", "atan2(cos(b) - cos(a), d + sin(a) - sin(b))", "{t} - a", "b - {t}"),
    ("2 + d * d - 2 * cos(a - b) + 2 * d * (sin(b) - sin(a))", "atan2(cos(a) - cos(b), d - sin(a) + sin(b))", "a - {t}", "{t} - b"),
    ("d * d - 2 + 2 * cos(a - b) + 2 * d * (sin(a) + sin(b))", "(atan2(-cos(a) - cos(b), d + sin(a) + sin(b)) - atan2(-2.0, sqrt(greatest(0, {q}))))", "{t} - a", "{t} - b"),
    ("d * d - 2 + 2 * cos(a - b) - 2 * d * (sin(a) + sin(b))", "(atan2(cos(a) + cos(b), d - sin(a) - sin(b)) - atan2(2.0, sqrt(greatest(0, {q}))))", "a - {t}", "b - {t}"),
]
_STRAIGHT = [(q, t.format(q=q), x, y) for q, t, x, y in _WORDS]
_STRAIGHT_SQL = ", ".join(f"CASE WHEN {q} >= 0 THEN {_turned(x.format(t=t))} + sqrt(greatest(0, {q})) + {_turned(y.format(t=t))} ELSE 1E9 END" for q, t, x, y in _STRAIGHT)
# words of three arcs: c the cosine of the middle one, p its length, then the first and the last arc
_ARCS_SQL = ", ".join(f"CASE WHEN abs({c}) <= 1 THEN {p} + {_turned(first)} + {_turned(last.format(first=_turned(first)))} ELSE 1E9 END" for c, p, first, last in (
    ("c1", "p1", "a - atan2(cos(a) - cos(b), d - sin(a) + sin(b)) + p1 / 2", "a - b - {first} + p1"), ("c2", "p2", "-a - atan2(cos(a) - cos(b), d + sin(a) - sin(b)) + p2 / 2", "b - a - {first} + p2")))


@query(f"""WITH n AS (SELECT field_id, task, xe, y, CASE WHEN xe >= xs THEN 0.0E0 ELSE pi() END AS yaw, lead(xs) OVER v AS nx, lead(y) OVER v AS ny, lead(CASE WHEN xe >= xs THEN 0.0E0 ELSE pi() END) OVER v AS nyaw FROM {{v_ordered}} WINDOW v AS (PARTITION BY field_id ORDER BY task)),
m AS (SELECT field_id, task, sqrt((nx - xe) * (nx - xe) + (ny - y) * (ny - y)) / 5 AS d, atan2(ny - y, nx - xe) AS theta, yaw, nyaw FROM n WHERE nx IS NOT NULL),
k AS (SELECT field_id, task, d, {_turned("yaw - theta")} AS a, {_turned("nyaw - theta")} AS b FROM m),
c AS (SELECT *, (6 - d * d + 2 * cos(a - b) + 2 * d * (sin(a) - sin(b))) / 8 AS c1, (6 - d * d + 2 * cos(a - b) + 2 * d * (sin(b) - sin(a))) / 8 AS c2 FROM k),
p AS (SELECT *, {_FULL} - acos(least(1, greatest(-1, c1))) AS p1, {_FULL} - acos(least(1, greatest(-1, c2))) AS p2 FROM c)
SELECT field_id, task, round(5 * least({_STRAIGHT_SQL}, {_ARCS_SQL}), 4) AS length FROM p""")
def nav_forward_turns(spark, sf_dir):
    return rounded(routing.forward_turns(view(spark, sf_dir, "v_ordered")), "length")


@query("""WITH RECURSIVE_HERE c AS (SELECT l_suppkey AS field_id, CAST(l_partkey % 12 AS INT) AS candidate, list(DISTINCT CAST(l_orderkey % 60 AS INT)) AS cells FROM {lineitem} GROUP BY 1, 2),
t AS (SELECT DISTINCT field_id, CAST([] AS INT[]) AS taken, CAST([] AS INT[]) AS covered, CAST(-1 AS INT) AS candidate, CAST(0 AS BIGINT) AS gain, 0 AS place FROM c
  UNION ALL SELECT field_id, list_append(taken, best), list_concat(covered, cells), best, fresh, place + 1 FROM (
    SELECT t.field_id, t.taken, t.covered, t.place, c.candidate AS best, c.cells, CAST(len(list_filter(c.cells, lambda x: NOT list_contains(t.covered, x))) AS BIGINT) AS fresh,
      row_number() OVER (PARTITION BY t.field_id ORDER BY len(list_filter(c.cells, lambda x: NOT list_contains(t.covered, x))) DESC, c.candidate) AS r
    FROM t JOIN c ON c.field_id = t.field_id AND NOT list_contains(t.taken, c.candidate)) q WHERE r = 1 AND fresh >= 2)
SELECT field_id, candidate, CAST(gain AS INT) AS gain, place FROM t WHERE place > 0""")
def hea_gap_cover(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("field_id"), (F.col("l_partkey") % 12).cast("int").alias("candidate"), (F.col("l_orderkey") % 60).cast("int").alias("cell")).distinct()
    return routing.gap_cover(cells, 2)


@query("""WITH n AS (SELECT DISTINCT l_suppkey AS field_id, l_orderkey % 30 AS cell, CAST(l_suppkey % 4 AS INT) AS region_id FROM {lineitem}), t AS (SELECT DISTINCT l_suppkey AS field_id, l_orderkey % 30 AS cell, CAST(l_partkey % 4 AS INT) AS region_id, CAST(l_partkey % 50 AS INT) AS task FROM {lineitem} WHERE l_quantity > 25)
SELECT field_id, cell, CAST(f AS INT) AS foreign, task FROM (SELECT n.field_id, n.cell, CASE WHEN t.region_id IS NULL THEN NULL WHEN t.region_id <> n.region_id THEN 1 ELSE 0 END AS f, t.task, row_number() OVER (PARTITION BY n.field_id, n.cell ORDER BY CASE WHEN t.region_id <> n.region_id THEN 1 ELSE 0 END, t.task) AS r FROM n LEFT JOIN t ON t.field_id = n.field_id AND t.cell = n.cell) q WHERE r = 1""")
def joi_cross_region(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    needs = rows.select(F.col("l_suppkey").alias("field_id"), (F.col("l_orderkey") % 30).alias("cell"), (F.col("l_suppkey") % 4).cast("int").alias("region_id")).distinct()
    tasks = rows.where("l_quantity > 25").select(F.col("l_suppkey").alias("field_id"), (F.col("l_orderkey") % 30).alias("cell"), (F.col("l_partkey") % 4).cast("int").alias("region_id"), (F.col("l_partkey") % 50).cast("int").alias("task")).distinct()
    return routing.cross_region_needs(needs, tasks)


ORACLES["joi_cross_region"] = ORACLES["joi_cross_region"].replace("AS foreign", 'AS "foreign"')


@query("""WITH RECURSIVE_HERE p AS (SELECT l_suppkey AS field_id, (l_partkey * 7 % 1800) / 10.0E0 AS angle, sum(l_quantity) AS weight FROM {lineitem} GROUP BY 1, 2),
o AS (SELECT field_id, angle, row_number() OVER (PARTITION BY field_id ORDER BY weight DESC, angle) AS r FROM p),
t AS (SELECT field_id, [angle] AS taken, r FROM o WHERE r = 1
  UNION ALL SELECT t.field_id, CASE WHEN len(t.taken) < 8 AND len(list_filter(t.taken, lambda b: least((o.angle - b) - 180 * floor((o.angle - b) / 180), (b - o.angle) - 180 * floor((b - o.angle) / 180)) < 3)) = 0 THEN list_append(t.taken, o.angle) ELSE t.taken END, o.r
  FROM t JOIN o ON o.field_id = t.field_id AND o.r = t.r + 1 WHERE len(t.taken) < 8)
SELECT field_id, unnest(taken) AS angle, CAST(generate_subscripts(taken, 1) AS INT) AS place FROM (SELECT field_id, max_by(taken, r) AS taken FROM t GROUP BY field_id) q""")
def top_distinct_directions(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("field_id"), ((F.col("l_partkey") * 7 % 1800) / 10.0).alias("angle"), "l_quantity").groupBy("field_id", "angle").agg(F.sum("l_quantity").alias("weight"))
    return routing.distinct_directions(p)


@query("""SELECT field_id, sha256(string_agg(CAST(sequence AS VARCHAR) || ':' || kind || ':' || CAST(task AS VARCHAR), ';' ORDER BY sequence)) AS fingerprint FROM {v_route} GROUP BY field_id""")
def set_fingerprint(spark, sf_dir):
    r = view(spark, sf_dir, "v_route").select("field_id", "sequence", F.concat_ws(":", F.col("sequence").cast("string"), "kind", F.col("task").cast("string")).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("sequence", "s")))
    return r.groupBy("field_id").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["s"]), ";"), 256).alias("fingerprint"))


@query("""SELECT DISTINCT attempts, status, sha256(CAST(attempts AS VARCHAR) || '|' || status) AS parameter_set_id FROM {v_status}""")
def snk_parameter_sets(spark, sf_dir):
    return view(spark, sf_dir, "v_status").select("attempts", "status", F.sha2(F.concat_ws("|", F.col("attempts").cast("string"), "status"), 256).alias("parameter_set_id")).dropDuplicates(["parameter_set_id"])


@query("""SELECT s.chain, s.n, round(s.total, 4) AS recomputed, abs(s.total - t.total) <= greatest(1E-4, 1E-8 * greatest(abs(s.total), abs(t.total))) AS agrees FROM (SELECT chain, count(*) AS n, sum(length) AS total FROM {v_legs} GROUP BY chain) s JOIN (SELECT l_orderkey AS chain, sum(l_quantity) AS total FROM {lineitem} GROUP BY l_orderkey) t ON t.chain = s.chain""")
def aud_time_recomputed(spark, sf_dir):
    p = T.phases(T.speed_envelope(legs(spark, sf_dir), ["chain"], "sequence"))
    mine = p.groupBy("chain").agg(F.countDistinct("sequence").alias("n"), F.sum("distance").alias("total"))
    other = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain")).agg(F.sum("l_quantity").alias("expected"))
    return mine.join(other, "chain").select("chain", "n", F.round("total", 4).alias("recomputed"), C.approx_equal(F.col("total"), F.col("expected")).alias("agrees"))


@query("""SELECT field_id, row_index, piece FROM {v_segments} WHERE (field_id, row_index) IN (SELECT field_id, row_index FROM {v_segments} GROUP BY field_id, row_index HAVING count(*) > 1)""")
def set_task_difference(spark, sf_dir):
    s = view(spark, sf_dir, "v_segments").select("field_id", "row_index", "piece")
    single = s.groupBy("field_id", "row_index").agg(F.min("piece").alias("piece"), F.count("*").alias("n")).where("n = 1").select("field_id", "row_index", "piece")
    return s.exceptAll(single)


@query()
def geo_spatial_order(spark, sf_dir):
    """Place of every region of every field. Only distinct shapes are numbered in one task: by v_fields they repeat every
    480 fields; regions of one shape are numbered by field."""
    return run(
        spark,
        sf_dir,
        """WITH g AS (SELECT field_id, region_id, x0, y0, (x1 - x0) * (y1 - y0) AS area FROM {v_regions}), n AS (SELECT x0, y0, area, count(*) AS n FROM g GROUP BY x0, y0, area),
        o AS (SELECT x0, y0, area, sum(n) OVER (ORDER BY x0, y0, -area) - n AS before FROM n)
        SELECT g.field_id, g.region_id, CAST(o.before + row_number() OVER (PARTITION BY g.x0, g.y0, g.area ORDER BY g.field_id, g.region_id) AS INT) AS place
        FROM g JOIN o ON o.x0 = g.x0 AND o.y0 = g.y0 AND o.area = g.area""",
    )


def _each_leg_from_its_own(text: str, at: int, start: str, end: str, old: str, spark: bool = True) -> str:
    """The text with samples every `at` metres from start to end of each leg in place of those of a fixed range."""
    if old not in text:
        raise ValueError("the text has other samples")
    lo, hi = (f"CAST(floor(({x}) / {at}) AS BIGINT)" for x in (start, end))
    if spark:
        return text.replace(old, f"e LATERAL VIEW explode(sequence({lo}, {hi})) k AS id WHERE k.id >= 0 AND ")
    return text.replace(old, f"e JOIN LATERAL (SELECT unnest(generate_series({lo}, {hi})) AS id) k ON ")


_BLOCKS = (SHARED["win_local_speed_blocks"], 25, "e.till - e.len", "e.till", "e JOIN (SELECT * FROM range(0, 400) AS t(id)) k ON ")
_SAMPLES = (
    """WITH e AS (SELECT chain, sequence, length, sum(length) OVER (PARTITION BY chain ORDER BY sequence) AS till FROM {v_legs}),
        s AS (SELECT e.*, k.id AS sample, k.id * 40.0E0 AS at_m FROM SAMPLES k.id * 40 >= e.till - e.length AND k.id * 40 < e.till)
        SELECT chain, sample, sequence, round((at_m - (till - length)) / length, 4) AS share FROM s""",
    40, "e.till - e.length", "e.till", "SAMPLES",
)


@query(_each_leg_from_its_own(*_BLOCKS, spark=False))
def win_local_speed_blocks(spark, sf_dir):
    return run(spark, sf_dir, _each_leg_from_its_own(*_BLOCKS))


@query(_each_leg_from_its_own(*_SAMPLES, spark=False))
def joi_asof_samples(spark, sf_dir):
    return run(spark, sf_dir, _each_leg_from_its_own(*_SAMPLES))
