"""The full geometry ledger over lines of operations, with SQL that goes line by line instead of step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import time_ledger as T
from furrow.operators.replay import unworked_travel
from furrow.plans.views import run, view

LEDGER: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LEDGER_SQL: dict[str, str] = {}

#: Tracks cut into operations of four steps; every seventh doesn't reach the next, and every twenty make a component.
_OPERATIONS = """ops AS (SELECT t.chain, k.sequence, CASE k.sequence % 3 WHEN 0 THEN 'WORK' WHEN 1 THEN 'CONNECTION' ELSE 'HEADLAND' END AS kind, CAST(floor(k.sequence / 20) AS INT) AS component, t.i, t.x, t.y FROM {v_track} t
JOIN (SELECT DISTINCT chain, CAST(floor((i - 1) / 4) AS INT) AS sequence FROM {v_track}) k ON k.chain = t.chain AND t.i >= 4 * k.sequence + 1 AND t.i <= 4 * k.sequence + CASE WHEN k.sequence % 7 = 6 THEN 4 ELSE 5 END)"""


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, f"WITH {_OPERATIONS} SELECT * FROM ops")


_ANGLE = "degrees(acos(least(1.0E0, greatest(-1.0E0, ({0}.dx * {1}.dx + {0}.dy * {1}.dy) / ({0}.l * {1}.l)))))"
_LINES = f"""{_OPERATIONS}, s0 AS (SELECT *, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM ops WINDOW w AS (PARTITION BY chain, sequence ORDER BY i)),
s1 AS (SELECT chain, sequence, kind, component, i, x, y, ex, ey, ex - x AS dx, ey - y AS dy, sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) AS l FROM s0 WHERE ex IS NOT NULL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY chain, sequence ORDER BY i) AS k, sum(l) OVER (PARTITION BY chain, sequence ORDER BY i) AS upto FROM s1 WHERE l > 1E-9),
inner_turns AS (SELECT b.chain, b.sequence, a.upto AS pos, {_ANGLE.format('a', 'b')} AS angle FROM s2 a JOIN s2 b ON b.chain = a.chain AND b.sequence = a.sequence AND b.k = a.k + 1),
ends AS (SELECT chain, sequence, min(kind) AS kind, min(component) AS component, max(k) AS k, sum(l) AS len FROM s2 GROUP BY chain, sequence),
l0 AS (SELECT e.*, e.kind <> 'CONNECTION' AS working, f.x, f.y, f.dx AS fx, f.dy AS fy, f.l AS fl, g.ex, g.ey, g.dx AS gx, g.dy AS gy, g.l AS gl, coalesce(c.curve, false) AS curve FROM ends e JOIN s2 f ON f.chain = e.chain AND f.sequence = e.sequence AND f.k = 1 JOIN s2 g ON g.chain = e.chain AND g.sequence = e.sequence AND g.k = e.k
LEFT JOIN (SELECT chain, sequence, bool_or(angle > 0.01E0) AS curve FROM inner_turns GROUP BY chain, sequence) c ON c.chain = e.chain AND c.sequence = e.sequence),
l1 AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY sequence) AS n FROM l0),
l2 AS (SELECT b.*, coalesce(a.working, false) AS was, CASE WHEN a.n IS NULL OR a.component <> b.component OR sqrt((a.ex - b.x) * (a.ex - b.x) + (a.ey - b.y) * (a.ey - b.y)) > 1E-5 THEN 1 ELSE 0 END AS fresh,
degrees(acos(least(1.0E0, greatest(-1.0E0, (a.gx * b.fx + a.gy * b.fy) / (a.gl * b.fl))))) AS turn FROM l1 b LEFT JOIN l1 a ON a.chain = b.chain AND a.n = b.n - 1),
l3 AS (SELECT *, sum(fresh) OVER (PARTITION BY chain ORDER BY n) AS part, coalesce(lead(fresh) OVER (PARTITION BY chain ORDER BY n), 1) AS next_fresh FROM l2),
l4 AS (SELECT *, sum(len) OVER (PARTITION BY chain, part ORDER BY n) - len AS start FROM l3),
events AS (SELECT chain, part, start AS pos, 'STOP_STEER' AS action, 2.0E0 AS s FROM l4 WHERE fresh = 0 AND turn > 35 UNION ALL SELECT l4.chain, part, start + t.pos, 'STOP_STEER', 2.0E0 FROM l4 JOIN inner_turns t ON t.chain = l4.chain AND t.sequence = l4.sequence WHERE t.angle > 35
UNION ALL SELECT chain, part, start, 'ON', 1.0E0 FROM l4 WHERE working AND (fresh = 1 OR NOT was) UNION ALL SELECT chain, part, start, 'OFF', 1.0E0 FROM l4 WHERE NOT working AND was AND fresh = 0 UNION ALL SELECT chain, part, start + len, 'OFF', 1.0E0 FROM l4 WHERE working AND next_fresh = 1),
acts AS (SELECT chain, part, CAST(round(pos / 1E-5) AS BIGINT) AS anchor, action, max(s) AS s FROM events GROUP BY ALL),
stops AS (SELECT chain, part, anchor, max(s) AS s, sum(s) AS u, count(*) FILTER (action = 'STOP_STEER') AS steer, count(*) FILTER (action <> 'STOP_STEER') AS switches FROM acts GROUP BY chain, part, anchor)"""

LEDGER_SQL["tim_geometry_ledger"] = f"""WITH {_LINES}, held AS (SELECT chain, sum(s) AS t_stop, count(*) AS stops, sum(steer) AS steer_stops, sum(switches) AS switches, sum(u - s) AS saved_s FROM stops GROUP BY chain),
times AS (SELECT chain, sum(CASE WHEN working THEN len / CASE WHEN curve THEN 0.8E0 ELSE 2.36E0 END ELSE 0 END) AS t_work, sum(CASE WHEN working THEN 0 ELSE len / CASE WHEN curve THEN 0.8E0 ELSE 2.36E0 END END) AS t_drive, sum(CASE WHEN NOT working AND curve THEN len / 0.8E0 ELSE 0 END) AS t_turn,
sum(CASE WHEN working THEN len ELSE 0 END) AS work_m, sum(CASE WHEN working THEN 0 ELSE len END) AS connection_m, max(part) AS chains FROM l4 GROUP BY chain)
SELECT t.chain, round(t_work, 3) AS t_work, round(t_drive, 3) AS t_drive, round(t_turn, 3) AS t_turn, round(coalesce(t_stop, 0), 3) AS t_stop, round(work_m, 3) AS work_m, round(connection_m, 3) AS connection_m, CAST(chains AS BIGINT) AS chains, coalesce(stops, 0) AS stops, CAST(coalesce(steer_stops, 0) AS BIGINT) AS steer_stops,
CAST(coalesce(switches, 0) AS BIGINT) AS switches, round(coalesce(saved_s, 0), 3) AS saved_s, CASE WHEN chains = 1 THEN round(t_work / (t_work + t_drive + coalesce(t_stop, 0)), 4) END AS ratio, CASE WHEN chains = 1 THEN 'ESTIMATED' ELSE 'INCOMPLETE' END AS status FROM times t LEFT JOIN held h ON h.chain = t.chain"""


def tim_geometry_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of every track by its lines alone: work, driving, turning and stops, for steering and switching merged by place."""
    out = T.geometry_ledger(operations(spark, sf_dir), ["chain"])
    rounded = {c: F.round(c, 3) for c in ("t_work", "t_drive", "t_turn", "t_stop", "work_m", "connection_m", "saved_s")}
    return out.withColumns({**rounded, "ratio": F.round("ratio", 4)})


LEDGER["tim_geometry_ledger"] = tim_geometry_ledger


LEDGER_SQL["aud_unworked_travel"] = """WITH o AS (SELECT field_id, row_index, 2 * task AS at, x0 AS u0, x1 AS u1 FROM {v_ordered}),
t AS (SELECT o.field_id, o.row_index + d.off AS row_index, o.at + 1 AS at, d.off, f.w FROM o JOIN (SELECT * FROM (VALUES (-1), (0), (1)) AS v(off)) d ON true JOIN {v_fields} f ON f.field_id = o.field_id)
SELECT t.field_id, t.row_index, t.at, CAST(t.off AS INT) AS off, round(w + 6.0E0, 3) AS length, round(w + 6 - 8 - coalesce(sum(CASE WHEN o.at < t.at THEN greatest(0.0E0, least(o.u1, w - 1.0E0) - greatest(o.u0, 1.0E0)) END), 0), 3) AS unworked
FROM t LEFT JOIN o ON o.field_id = t.field_id AND o.row_index = t.row_index GROUP BY t.field_id, t.row_index, t.at, t.off, w"""


def aud_unworked_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifted travel along each task's row and both neighbours right after the task: how much of it wasn't worked before.

    Travel goes 3 m beyond both sides of the field; 4 m at each end are free.
    """
    keys = ("field_id", "row_index")
    tasks = view(spark, sf_dir, "v_ordered")
    wide = tasks.join(view(spark, sf_dir, "v_fields").select("field_id", "w"), "field_id")
    work = tasks.select(*keys, F.col("x0").alias("u0"), F.col("x1").alias("u1"), (2 * F.col("task")).alias("at"))
    off = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1)))).alias("off")
    travel = wide.select("field_id", "row_index", "task", "w", off).select("field_id", (F.col("row_index") + F.col("off")).alias("row_index"), F.struct("task", "off").alias("travel"), F.lit(-3.0).alias("u0"), (F.col("w") + 3.0).alias("u1"), (2 * F.col("task") + 1).alias("at"))
    ends = travel.select(*keys, F.col("u1").alias("far")).distinct()
    free = ends.select(*keys, F.explode(F.array(F.struct(F.lit(-3.0).alias("u0"), F.lit(1.0).alias("u1")), F.struct((F.col("far") - 4.0).alias("u0"), F.col("far").alias("u1")))).alias("f")).select(*keys, "f.*")
    out = unworked_travel(travel, work, keys, free)
    return out.select(*keys, "at", F.col("travel.off").alias("off"), F.round("length", 3).alias("length"), F.round("unworked", 3).alias("unworked"))


LEDGER["aud_unworked_travel"] = aud_unworked_travel
