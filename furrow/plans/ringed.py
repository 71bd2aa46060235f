"""Queries over polygons in general position and over motions, each with SQL that takes another way.

Fields are the given ones turned about the origin, each by one of three angles, so no edge keeps an axis. The operators
see only the turned vertices; the SQL has closed forms of the unturned fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import columns as C
from furrow.operators import rings as R
from furrow.plans.views import view

RINGED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RING_SQL: dict[str, str] = {}
SPACING = 3.675


def query(sql: str):
    def add(f):
        RINGED[f.__name__] = f
        RING_SQL[f.__name__] = sql
        return f

    return add


def _turn() -> tuple:
    """Cosine and sine of a field's angle, of right triangles with whole sides."""
    which = F.floor(F.col("field_id") / 3) % 3
    pick = lambda *v: F.when(which == 0, F.lit(v[0])).when(which == 1, F.lit(v[1])).otherwise(F.lit(v[2]))
    return pick(3 / 5, 5 / 13, 8 / 17), pick(4 / 5, 12 / 13, 15 / 17)


def turned(points: DataFrame) -> DataFrame:
    c, s = _turn()
    return points.withColumns({"x": F.col("x") * c - F.col("y") * s, "y": F.col("x") * s + F.col("y") * c})


def turned_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turned(view(spark, sf_dir, "v_rings").select("field_id", "ring", "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))


def framed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _turn()
    return R.in_frame(R.edges_of(turned_rings(spark, sf_dir)), F.atan2(s, c))


_PARTS = """p AS (SELECT field_id, kind, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, floor(w / 2) * 1.0E0 AS w2, floor(h / 2) * 1.0E0 AS h2, floor(w / 3) * 1.0E0 AS w3, floor(h / 3) * 1.0E0 AS h3 FROM {v_fields})"""


def _area(a: str, b: str) -> str:
    """SQL of the area between two heights of an unturned field."""
    over = lambda c, d: f"greatest(0.0E0, least({b}, {d}) - greatest({a}, {c}))"
    return f"CASE kind WHEN 0 THEN w * {over('0.0E0', 'h')} WHEN 1 THEN w * {over('0.0E0', 'h2')} + w2 * {over('h2', 'h')} ELSE w * {over('0.0E0', 'h')} - w3 * {over('h3', '2 * h3')} END"


@query(f"WITH {_PARTS} SELECT field_id, 'VALID' AS status, CASE kind WHEN 0 THEN w * h WHEN 1 THEN w * h2 + w2 * (h - h2) ELSE w * h - w3 * h3 END AS area FROM p WHERE field_id % 5 <> 0 UNION ALL SELECT field_id, 'SELF_CROSSING', NULL FROM p WHERE field_id % 5 = 0")
def geo_polygon_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and net area of turned polygons; every fifth has two vertices of its outside exchanged."""
    place = F.when((F.col("field_id") % 5 == 0) & (F.col("ring") == 0) & F.col("i").isin(1, 2), 3 - F.col("i")).otherwise(F.col("i"))
    out = R.polygon_status(turned_rings(spark, sf_dir).withColumn("i", place))
    return out.select("field_id", "status", F.when(F.col("status") == "VALID", F.round("area", 4)).alias("area"))


@query(f"WITH {_PARTS} SELECT field_id, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 8 END AS vertices, CASE kind WHEN 0 THEN w * h WHEN 1 THEN w * h2 + w2 * (h - h2) ELSE w * h - w3 * h3 END AS area, field_id % 2 = 0 AS repaired FROM p")
def geo_without_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned polygons, half of which go 10 m past their second vertex and back, without that spike."""
    rings = view(spark, sf_dir, "v_rings").select("field_id", "ring", F.col("i").cast("double").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    at = rings.where("field_id % 2 = 0 and ring = 0 and i = 1")
    spiked = rings.union(at.select("field_id", "ring", F.col("i") + 0.3, F.col("x") + 10, "y")).union(at.select("field_id", "ring", F.col("i") + 0.6, "x", "y"))
    clean = R.without_spikes(turned(spiked))
    counts = clean.groupBy("field_id").agg(F.count("*").cast("int").alias("vertices"))
    before = spiked.groupBy("field_id").agg(F.count("*").alias("n"))
    status = R.polygon_status(clean)
    return status.join(counts, "field_id").join(before, "field_id").select("field_id", "vertices", F.round("area", 4).alias("area"), (F.col("n") != F.col("vertices")).alias("repaired"))


@query(f"""WITH {_PARTS}, l AS (SELECT p.*, k.id AS line, (k.id + 0.5E0) * {SPACING}E0 AS y FROM p JOIN (SELECT * FROM range(0, 1000) AS t(id)) k ON (k.id + 0.5E0) * {SPACING}E0 < h),
s AS (SELECT field_id, line, 1 AS piece, 0.0E0 AS u0, CASE WHEN kind = 1 AND y > h2 THEN w2 WHEN kind = 2 AND y > h3 AND y < 2 * h3 THEN w3 ELSE w END AS u1 FROM l
UNION ALL SELECT field_id, line, 2, 2 * w3, w FROM l WHERE kind = 2 AND y > h3 AND y < 2 * h3)
SELECT field_id, CAST(line AS BIGINT) AS line, piece, round(u0, 4) + 0.0E0 AS u0, round(u1, 4) AS u1 FROM s""")
def swa_clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work lines of a turned field, clipped to its outside and holes."""
    out = R.parallel_segments(framed_edges(spark, sf_dir), SPACING, SPACING / 2)
    return out.select("field_id", "line", "piece", *((F.round(c, 4) + 0.0).alias(c) for c in ("u0", "u1")))


@query(f"WITH {_PARTS}, l AS (SELECT p.*, k.id AS strip, k.id * {SPACING}E0 AS a, (k.id + 1) * {SPACING}E0 AS b FROM p JOIN (SELECT * FROM range(0, 1000) AS t(id)) k ON k.id * {SPACING}E0 < h) SELECT field_id, CAST(strip AS BIGINT) AS strip, round({_area('a', 'b')}, 3) AS area FROM l WHERE {_area('a', 'b')} > 1E-6")
def swa_strip_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a turned field that each strip of the working width covers."""
    out = R.strip_areas(framed_edges(spark, sf_dir), SPACING)
    return out.where("area > 1e-6").select("field_id", "strip", F.round("area", 3).alias("area"))


@query(f"WITH {_PARTS}, l AS (SELECT p.*, k.id AS cut, h * k.id / 4 AS c FROM p JOIN (SELECT * FROM range(1, 4) AS t(id)) k ON true) SELECT field_id, CAST(cut AS BIGINT) AS cut, round({_area('0.0E0', 'c')}, 4) AS below, round({_area('c', 'h')}, 4) AS above FROM l")
def par_half_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas on both sides of cuts at quarters of a turned field's height."""
    cuts = view(spark, sf_dir, "v_fields").select("field_id", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("cut")).select("field_id", "cut", (F.col("h") * F.col("cut") / 4).alias("level"))
    out = R.half_plane_areas(framed_edges(spark, sf_dir), cuts)
    return out.select("field_id", "cut", F.round("below", 4).alias("below"), F.round("above", 4).alias("above"))


@query(f"""WITH {_PARTS} SELECT field_id, 0 AS ring, side, round(reach, 3) AS reach FROM (
SELECT field_id, 'IN' AS side, w2 AS reach FROM p WHERE kind = 1 UNION ALL SELECT field_id, 'OUT', h2 FROM p WHERE kind = 1) q
UNION ALL SELECT field_id, 1, side, round(reach, 3) FROM (SELECT field_id, 'IN' AS side, w3 AS reach FROM p WHERE kind = 2 UNION ALL SELECT field_id, 'OUT', h3 FROM p WHERE kind = 2
UNION ALL SELECT field_id, 'IN', w - 2 * w3 FROM p WHERE kind = 2 UNION ALL SELECT field_id, 'OUT', h - 2 * h3 FROM p WHERE kind = 2
UNION ALL SELECT field_id, 'IN', h3 FROM p WHERE kind = 2 UNION ALL SELECT field_id, 'OUT', w - 2 * w3 FROM p WHERE kind = 2
UNION ALL SELECT field_id, 'IN', h - 2 * h3 FROM p WHERE kind = 2 UNION ALL SELECT field_id, 'OUT', w3 FROM p WHERE kind = 2) q""")
def par_reflex_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the edges at notches of turned fields can be drawn on inside."""
    edges = R.edges_of(turned_rings(spark, sf_dir))
    out = R.first_hits(R.reflex_rays(edges), edges, ["field_id", "ring", "x", "y", "side"])
    return out.select("field_id", "ring", "side", F.round("reach", 3).alias("reach"))


_GRID = "SELECT field_id, kind, w, h, k.id AS n, (k.id * 37) % (w + 20) - 9.5E0 AS x, (k.id * 53) % (h + 20) - 9.5E0 AS y FROM {v_fields} JOIN (SELECT * FROM range(0, 60) AS t(id)) k ON true"


@query(f"WITH {_PARTS}, g AS ({_GRID}) SELECT g.field_id, CAST(n AS BIGINT) AS n, x > 0 AND x < p.w AND y > 0 AND y < p.h AND NOT (p.kind = 1 AND x > w2 AND y > h2) AND NOT (p.kind = 2 AND x > w3 AND x < 2 * w3 AND y > h3 AND y < 2 * h3) AS inside FROM g JOIN p ON p.field_id = g.field_id")
def joi_points_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether points in and around turned fields lie inside them."""
    fields = view(spark, sf_dir, "v_fields").select("field_id", "w", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("n"))
    points = turned(fields.select("field_id", "n", ((F.col("n") * 37) % (F.col("w") + 20) - 9.5).alias("x"), ((F.col("n") * 53) % (F.col("h") + 20) - 9.5).alias("y")))
    return R.points_inside(points, R.edges_of(turned_rings(spark, sf_dir)), ["field_id", "n"])


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of a motion, with the gear at its start and the change of heading."""
    w = Window.partitionBy("chain").orderBy("i")
    track = view(spark, sf_dir, "v_track").select("chain", "i", "x", "y", "gear", "yaw", *(F.lead(c).over(w).alias(f"n{c}") for c in ("x", "y", "yaw")), F.lag("gear").over(w).alias("before"))
    return track.where("nx is not null").withColumn("dyaw", C.wrap_angle(F.col("nyaw") - F.col("yaw")))


_STEPS = """s AS (SELECT * FROM (SELECT chain, i, x, y, gear, yaw, lead(x) OVER v AS nx, lead(y) OVER v AS ny, lead(yaw) OVER v AS nyaw, lag(gear) OVER v AS prior FROM {v_track} WINDOW v AS (PARTITION BY chain ORDER BY i)) q WHERE nx IS NOT NULL),
d AS (SELECT *, CASE WHEN nyaw - yaw >= pi() THEN nyaw - yaw - 2 * pi() WHEN nyaw - yaw < -pi() THEN nyaw - yaw + 2 * pi() ELSE nyaw - yaw END AS dyaw FROM s)"""


@query(f"""WITH {_STEPS}, t AS (SELECT chain, sum(CASE WHEN prior <> gear THEN 1 ELSE 0 END) AS shifts, sum(CASE WHEN gear < 0 AND (prior IS NULL OR prior > 0) THEN 1 ELSE 0 END) AS backs,
sum(CASE WHEN gear < 0 THEN 1 ELSE 0 END) AS behind, sum(abs(dyaw)) AS winding, sum(dyaw) AS net FROM d GROUP BY chain)
SELECT chain, CAST(shifts AS BIGINT) AS shifts, CAST(backs AS BIGINT) AS reverse_runs, round(winding, 6) AS winding, CASE WHEN shifts <= 4 AND backs <= 2 AND winding <= 2 * pi() - 0.1E0 THEN 'BLOCK_TRANSFER' END AS transfer, behind = 0 AND winding <= abs(net) + 0.08E0 AS corner FROM t""")
def kin_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each motion as a transfer between blocks, and whether it is a plain forward corner."""
    steps = _steps(spark, sf_dir)
    out = steps.groupBy("chain").agg(
        F.count_if(F.col("before") != F.col("gear")).alias("shifts"), F.count_if((F.col("gear") < 0) & (F.coalesce("before", F.lit(1)) > 0)).alias("reverse_runs"),
        F.count_if(F.col("gear") < 0).alias("behind"), F.sum(F.abs("dyaw")).alias("winding"), F.sum("dyaw").alias("net"),
    )
    return out.select("chain", "shifts", "reverse_runs", F.round("winding", 6).alias("winding"), C.transfer_class(F.col("shifts"), F.col("reverse_runs"), F.col("winding")).alias("transfer"), C.forward_corner(F.col("behind"), F.col("winding"), F.col("net")).alias("corner"))


@query(f"WITH {_STEPS}, n AS (SELECT *, i - row_number() OVER (PARTITION BY chain, gear ORDER BY i) AS run FROM d) SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY min(i)) AS INT) AS part, gear, min(i) AS first_i, max(i) + 1 AS last_i, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 6) AS length FROM n GROUP BY chain, gear, run")
def kin_motion_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motions split where the driving gear changes."""
    w = Window.partitionBy("chain").orderBy("i")
    steps = _steps(spark, sf_dir).withColumn("part", F.sum(F.when(F.col("before") == F.col("gear"), 0).otherwise(1)).over(w))
    out = steps.groupBy("chain", F.col("part").cast("int").alias("part")).agg(F.first("gear").alias("gear"), F.min("i").alias("first_i"), (F.max("i") + 1).alias("last_i"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("length"))
    return out.withColumn("length", F.round("length", 6))


@query(f"""WITH {_STEPS}, m AS (SELECT chain, i, x, y, nx, ny, (nx - x) / sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS ux, (ny - y) / sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS uy FROM d WHERE nx <> x OR ny <> y),
a AS (SELECT *, CASE WHEN lag(ux) OVER v IS NULL THEN NULL ELSE degrees(acos(least(1.0E0, greatest(-1.0E0, ux * lag(ux) OVER v + uy * lag(uy) OVER v)))) END AS angle, row_number() OVER v AS k, row_number() OVER (PARTITION BY chain ORDER BY i DESC) AS z FROM m WINDOW v AS (PARTITION BY chain ORDER BY i))
SELECT chain, round(coalesce(max(angle), 0), 4) AS max_angle, round(max(CASE WHEN k = 1 THEN ux END), 6) + 0.0E0 AS start_x, round(max(CASE WHEN k = 1 THEN uy END), 6) + 0.0E0 AS start_y, round(max(CASE WHEN z = 1 THEN ux END), 6) + 0.0E0 AS end_x, round(max(CASE WHEN z = 1 THEN uy END), 6) + 0.0E0 AS end_y FROM a GROUP BY chain""")
def geo_line_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest turn inside each polyline and its directions at both ends, steps of no length left out."""
    w = Window.partitionBy("chain").orderBy("i")
    steps = _steps(spark, sf_dir).select("chain", "i", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy")).where("dx <> 0 or dy <> 0")
    steps = steps.withColumn("angle", F.when(F.lag("dx").over(w).isNotNull(), C.vector_angle_deg(F.lag("dx").over(w), F.lag("dy").over(w), F.col("dx"), F.col("dy"))))
    unit = F.struct((F.col("dx") / F.hypot("dx", "dy")).alias("x"), (F.col("dy") / F.hypot("dx", "dy")).alias("y"))
    out = steps.groupBy("chain").agg(F.coalesce(F.max("angle"), F.lit(0.0)).alias("angle"), F.min_by(unit, "i").alias("s"), F.max_by(unit, "i").alias("e"))
    return out.select("chain", F.round("angle", 4).alias("max_angle"), *((F.round(f"{p[0]}.{c}", 6) + 0.0).alias(f"{p}_{c}") for p in ("start", "end") for c in "xy"))


SKIPS = (3, 4, 6, 7)


@query("""WITH r AS (SELECT DISTINCT field_id, row_index, dense_rank() OVER (PARTITION BY field_id ORDER BY row_index) - 1 AS rank FROM {v_segments}),
n AS (SELECT field_id, count(*) AS rows FROM r GROUP BY field_id),
k AS (SELECT DISTINCT n.field_id, least(t.skip, n.rows) AS skip FROM n JOIN (SELECT * FROM (VALUES (3), (4), (6), (7)) AS t(skip)) t ON least(t.skip, n.rows) > 2),
o AS (SELECT k.field_id, k.skip, r.row_index, row_number() OVER (PARTITION BY k.field_id, k.skip ORDER BY r.rank % k.skip, r.rank) - 1 AS turn FROM k JOIN r ON r.field_id = k.field_id)
SELECT o.field_id, CAST(o.skip AS INT) AS skip, o.row_index, s.piece, o.turn % 2 = 1 AS backwards, CAST(row_number() OVER (PARTITION BY o.field_id, o.skip ORDER BY o.turn, CASE WHEN o.turn % 2 = 1 THEN -s.piece ELSE s.piece END) AS INT) AS place
FROM o JOIN {v_segments} s ON s.field_id = o.field_id AND s.row_index = o.row_index""")
def win_refined_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that leave 3, 4, 6 or 7 rows between neighbours, there and back in turn; every task once in each."""
    tasks = view(spark, sf_dir, "v_segments").select("field_id", "row_index", "piece")
    rows = tasks.groupBy("field_id", "row_index").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    by_field = Window.partitionBy("field_id")
    rows = rows.select("*", F.row_number().over(by_field.orderBy("row_index")).alias("rank"), F.count("*").over(by_field).alias("n"))
    skips = F.array_distinct(F.filter(F.transform(F.array(*map(F.lit, SKIPS)), lambda k: F.least(k.cast("long"), F.col("n"))), lambda k: k > 2))
    dealt = rows.select("field_id", "row_index", "pieces", "rank", F.explode(skips).alias("skip")).withColumn("skip", F.col("skip").cast("int"))
    order = Window.partitionBy("field_id", "skip").orderBy(F.pmod(F.col("rank") - 1, F.col("skip")), "rank")
    dealt = dealt.withColumn("turn", F.row_number().over(order))
    back = F.col("turn") % 2 == 0
    out = dealt.select("field_id", "skip", "row_index", "turn", back.alias("backwards"), F.posexplode(F.when(back, F.reverse("pieces")).otherwise(F.col("pieces"))).alias("k", "piece"))
    place = F.row_number().over(Window.partitionBy("field_id", "skip").orderBy("turn", "k"))
    return out.select("field_id", "skip", "row_index", "piece", "backwards", place.cast("int").alias("place"))


@query(f"""WITH {_STEPS}, m AS (SELECT chain, i, nx - x AS dx, ny - y AS dy, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS l FROM d WHERE nx <> x OR ny <> y),
a AS (SELECT chain, i, coalesce(sum(l) OVER (PARTITION BY chain ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS progress, CASE WHEN lag(dx) OVER v IS NULL THEN NULL ELSE degrees(acos(least(1.0E0, greatest(-1.0E0, (dx * lag(dx) OVER v + dy * lag(dy) OVER v) / (l * lag(l) OVER v))))) END AS angle FROM m WINDOW v AS (PARTITION BY chain ORDER BY i))
SELECT chain, i, round(progress, 4) AS progress_m, CAST(round(round(progress, 4) / 1E-5) AS BIGINT) AS anchor FROM a WHERE angle > 35""")
def tim_steering_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops for steering, where a route turns by more than 35 degrees, with the key that merges stops at one place."""
    w = Window.partitionBy("chain").orderBy("i")
    steps = _steps(spark, sf_dir).select("chain", "i", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy")).where("dx <> 0 or dy <> 0")
    length = F.hypot("dx", "dy")
    at = F.round(F.sum(length).over(w) - length, 4)
    angle = C.vector_angle_deg(F.lag("dx").over(w), F.lag("dy").over(w), F.col("dx"), F.col("dy"))
    return steps.select("chain", "i", angle.alias("angle"), at.alias("progress_m"), F.lag("dx").over(w).alias("before")).where("before is not null and angle > 35").select("chain", "i", "progress_m", F.round(F.col("progress_m") / 1e-5).cast("long").alias("anchor"))


@query(f"""WITH {_STEPS}, m AS (SELECT chain, i, abs(dyaw) AS theta, nx - x AS dx, ny - y AS dy, yaw, nyaw, sin(nyaw - yaw) AS turn FROM d),
t AS (SELECT *, least((dx * sin(nyaw) - dy * cos(nyaw)) / turn, (cos(yaw) * dy - sin(yaw) * dx) / turn) AS trim_m, tan(theta / 2) AS tg FROM m WHERE theta >= 1E-5 AND theta <= pi() - 1E-3 AND turn <> 0)
SELECT * FROM (SELECT chain, i, round((trim_m + sqrt(greatest(0, trim_m * trim_m - 2 * tg / 0.15E0))) / (2 * tg), 4) AS radius FROM t WHERE trim_m > 0 AND trim_m * trim_m - 2 * tg / 0.15E0 > 0) q WHERE radius > 6.00001E0""")
def top_gentle_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gentle radii for corners between the poses of each step, where one fits."""
    radius = C.gentle_radius(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("yaw"), F.col("nyaw"), 0.15, 6.0)
    return _steps(spark, sf_dir).select("chain", "i", F.round(radius, 4).alias("radius")).where("radius > 6.00001")


@query("""SELECT batch, CAST(count(*) AS BIGINT) AS regions, CASE WHEN sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) = 0 AND min(status) = 'ESTIMATED' AND max(status) = 'ESTIMATED' AND CAST(sum(attempts) AS BIGINT) % 2 = 0 THEN 'SWATHS_COMPLETE'
WHEN sum(CASE WHEN status = 'ESTIMATED' THEN 1 ELSE 0 END) >= 1 THEN 'SWATHS_PARTIAL' ELSE 'SWATHS_NOT_FOUND' END AS status FROM {v_status} GROUP BY batch""")
def sta_stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage of each batch from the states of its regions; an odd sum of attempts stands for an open ledger."""
    out = view(spark, sf_dir, "v_status").groupBy("batch").agg(F.count("*").alias("regions"), F.count_if(F.col("status") == "ESTIMATED").alias("complete"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum("attempts").alias("attempts"))
    return out.select("batch", "regions", C.stage_status(F.col("regions"), F.col("complete"), F.col("failed") == 0, F.col("attempts") % 2 == 0).alias("status"))
