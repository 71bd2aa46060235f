"""Time ledgers of ordered operations: chains, reachable speeds, phases, stops and efficiency, all as windows.

A chain's blocks are ordered; the speed at each node is bounded by the neighbouring limits and by stops, and reachable
from both sides with the ramps of the blocks between. With prefix sums of the ramps, the sequential forward and
backward passes become two running minima, so a chain needs one shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import vector_angle_deg
from furrow.params import Speeds, Stops

LEAST_PHASE = 1e-10


def chain_numbers(df: DataFrame, keys: list[str], order: str, breaks: Column, out: str = "chain") -> DataFrame:
    """Numbers chains from 1 in each key; `breaks` is true where a row begins a new one (over `prev_` columns)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_first", F.row_number().over(w) == 1).withColumn(out, F.sum(F.when(F.col("_first") | F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w)).drop("_first")


def with_progress(df: DataFrame, keys: list[str], order: str, length: str = "length") -> DataFrame:
    """start_m and end_m of each row along its chain."""
    w = Window.partitionBy(*keys).orderBy(order)
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end_m", end).withColumn("start_m", F.col("end_m") - F.col(length))


def speed_envelope(blocks: DataFrame, keys: list[str], order: str, speeds: Speeds | None = None) -> DataFrame:
    """v0, v1 (speeds at both ends), accel and decel of blocks with columns length, cap, working.

    Stops stand at chain ends and where `working` changes.
    """
    s = speeds or Speeds()
    w = Window.partitionBy(*keys).orderBy(order)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    cap, length = F.col("cap"), F.col("length")
    df = blocks.withColumns({
        "_pc": F.when(F.lag("working").over(w) == F.col("working"), F.lag("cap").over(w)).otherwise(F.lit(0.0)),
        "_nc": F.when(F.lead("working").over(w) == F.col("working"), F.lead("cap").over(w)).otherwise(F.lit(0.0)),
    })
    ramp = lambda other: F.when(cap > other, cap - other).otherwise(cap) / s.ramp_seconds
    df = df.withColumns({"accel": ramp(F.col("_pc")), "decel": ramp(F.col("_nc")), "_b0": F.pow(F.least(F.col("_pc"), cap), 2), "_b1": F.pow(F.least(F.col("_nc"), cap), 2)})
    df = df.withColumns({"_u": 2 * F.col("accel") * length, "_d": 2 * F.col("decel") * length})
    df = df.withColumns({"_s1": F.sum("_u").over(up), "_t0": F.sum("_d").over(down)})
    df = df.withColumns({"_s0": F.col("_s1") - F.col("_u"), "_t1": F.col("_t0") - F.col("_d")})
    df = df.withColumns({"_f": F.min(F.col("_b0") - F.col("_s0")).over(up), "_g": F.min(F.col("_b1") - F.col("_t1")).over(down)})
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    df = df.withColumns({"v0": root(F.least(F.col("_s0") + F.col("_f"), F.col("_t0") + F.col("_g"))), "v1": root(F.least(F.col("_b1"), F.col("_s1") + F.col("_f"), F.col("_t1") + F.col("_g")))})
    a, d = F.col("accel"), F.col("decel")
    peak = root((2 * a * d * length + d * F.pow("v0", 2) + a * F.pow("v1", 2)) / (a + d))
    df = df.withColumn("peak", F.greatest(F.least(cap, peak), "v0", "v1"))
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def phases(envelope: DataFrame) -> DataFrame:
    """ACCEL, CRUISE and DECEL rows of each block of `speed_envelope`, with distance, speeds and seconds."""
    square = lambda x, y, r: F.greatest((F.pow(x, 2) - F.pow(y, 2)) / (2 * F.col(r)), F.lit(0.0))
    df = envelope.withColumns({"_up": square("peak", "v0", "accel"), "_down": square("peak", "v1", "decel")})
    df = df.withColumn("_cruise", F.greatest(F.col("length") - F.col("_up") - F.col("_down"), F.lit(0.0)))
    part = lambda n, k, d, v, w: F.struct(F.lit(n).alias("n"), F.lit(k).alias("phase"), F.col(d).alias("distance"), F.col(v).alias("entry"), F.col(w).alias("exit"))
    parts = F.array(part(0, "ACCEL", "_up", "v0", "peak"), part(1, "CRUISE", "_cruise", "peak", "peak"), part(2, "DECEL", "_down", "peak", "v1"))
    df = df.withColumn("_p", F.explode(parts)).where(F.col("_p.distance") > LEAST_PHASE)
    df = df.select(*(c for c in envelope.columns), F.col("_p.n").alias("phase_no"), *(F.col(f"_p.{c}").alias(c) for c in ("phase", "distance", "entry", "exit")))
    return df.withColumn("seconds", 2 * F.col("distance") / (F.col("entry") + F.col("exit")))


def moving_events(phase_rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adjacent ACCEL or DECEL phases of one kind that touch become one event."""
    w = Window.partitionBy(*keys).orderBy(order, "phase_no")
    df = phase_rows.withColumn("_end", F.sum("distance").over(w)).withColumn("_start", F.col("_end") - F.col("distance")).where("phase <> 'CRUISE'")
    same = (F.lag("phase").over(w) == F.col("phase")) & (F.abs(F.lag("_end").over(w) - F.col("_start")) < 1e-8)
    df = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("event_no", F.sum("_new").over(w))
    return df.groupBy(*keys, "event_no", "phase").agg(
        F.min("_start").alias("start_m"), F.max("_end").alias("end_m"), F.sum("distance").alias("distance"), F.sum("seconds").alias("seconds"),
        F.min_by("entry", F.struct(order, "phase_no")).alias("v_before"), F.max_by("exit", F.struct(order, "phase_no")).alias("v_after"),
    )


def merged_stops(events: DataFrame, keys: list[str]) -> DataFrame:
    """Stops at one place merge: each action lasts its longest, the stop its longest action. events: keys, progress, action, seconds."""
    action = events.groupBy(*keys, "progress", "action").agg(F.max("seconds").alias("seconds"), F.sum("seconds").alias("each"))
    return action.groupBy(*keys, "progress").agg(F.max("seconds").alias("stop_seconds"), F.sum("each").alias("unmerged_seconds"), F.array_join(F.array_sort(F.collect_set("action")), ";").alias("actions"))


def switch_stops(rows: DataFrame, keys: list[str], order: str, stops: Stops | None = None) -> DataFrame:
    """Implement stops (keys, progress, action, seconds): ON where work begins, OFF where it ends, of rows with start_m, end_m."""
    s = stops or Stops()
    w = Window.partitionBy(*keys).orderBy(order)
    df = rows.withColumns({"_was": F.coalesce(F.lag("working").over(w), F.lit(False)), "_next": F.coalesce(F.lead("working").over(w), F.lit(False))})
    on, off = F.col("working") & ~F.col("_was"), F.col("working") & ~F.col("_next")
    made = F.filter(F.array(*(F.when(c, F.struct(F.col(p).alias("progress"), F.lit(a).alias("action"))) for c, p, a in ((on, "start_m", "ON"), (off, "end_m", "OFF")))), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(made).alias("e")).select(*keys, "e.progress", "e.action", F.lit(s.switch).alias("seconds"))


def efficiency(times: DataFrame, keys: list[str]) -> DataFrame:
    """Ratio of work time to all time, null with any issue. times: keys, t_work, t_drive, t_stop, issues."""
    total = F.col("t_work") + F.col("t_drive") + F.col("t_stop")
    return times.select(*keys, "t_work", "t_drive", "t_stop", F.when((F.col("issues") == 0) & (total > 0), F.col("t_work") / total).alias("ratio"), F.when(F.col("issues") == 0, F.lit("ESTIMATED")).otherwise(F.lit("INCOMPLETE")).alias("status"))


def batch_ratio(fields: DataFrame) -> DataFrame:
    """One row: fields, estimated fields, sums, and the ratio of sums, which is null unless every field is estimated."""
    n, ok = F.count("*"), F.count_if(F.col("status") == "ESTIMATED")
    total = F.sum(F.col("t_work") + F.col("t_drive") + F.col("t_stop"))
    return fields.agg(n.alias("n_fields"), ok.alias("n_estimated"), F.sum("t_work").alias("t_work"), total.alias("t_total"), F.when((n > 0) & (n == ok), F.sum("t_work") / total).alias("ratio"))


POSITION_EPS_M, MOVEMENT_EPS_M, CURVE_DEG, STEER_DEG = 1e-5, 1e-9, 0.01, 35.0


def operation_steps(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """One row a step of each operation's line, in the order of its key, with run (the number of its chain), progress, angle and curve.

    vertices: keys, sequence, kind (WORK, HEADLAND or CONNECTION), component, i, x, y. Steps of no length go. A chain
    breaks where the component changes or a line doesn't begin where the one before it ended. `angle` is the turn at the
    step's start inside its chain, null at a chain's beginning; `curve` says whether the operation's line bends.
    """
    in_line = Window.partitionBy(*keys, "sequence").orderBy("i")
    steps = vertices.withColumns({"bx": F.lead("x").over(in_line), "by": F.lead("y").over(in_line)}).where("bx is not null")
    steps = steps.withColumns({"dx": F.col("bx") - F.col("x"), "dy": F.col("by") - F.col("y")}).withColumn("length", F.hypot("dx", "dy")).where(F.col("length") > MOVEMENT_EPS_M)
    steps = steps.withColumn("working", F.col("kind").isin("WORK", "HEADLAND"))
    way = Window.partitionBy(*keys).orderBy("sequence", "i")
    was = {f"was_{c}": F.lag(c).over(way) for c in ("sequence", "component", "bx", "by", "dx", "dy", "working")}
    steps = steps.withColumns(was)
    opens = F.coalesce(F.col("was_sequence") != F.col("sequence"), F.lit(True))
    breaks = F.col("was_sequence").isNull() | (opens & (~F.col("was_component").eqNullSafe(F.col("component")) | (F.hypot(F.col("was_bx") - F.col("x"), F.col("was_by") - F.col("y")) > POSITION_EPS_M)))
    steps = steps.withColumns({"opens": opens, "breaks": breaks})
    steps = steps.withColumn("run", F.sum(F.col("breaks").cast("int")).over(way))
    turn = F.when(~F.col("breaks"), vector_angle_deg(F.col("was_dx"), F.col("was_dy"), F.col("dx"), F.col("dy")))
    along = Window.partitionBy(*keys, "run").orderBy("sequence", "i").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"angle": turn, "end_m": F.sum("length").over(along)}).withColumn("start_m", F.col("end_m") - F.col("length"))
    bends = F.max(F.coalesce((F.col("angle") > CURVE_DEG) & ~F.col("opens"), F.lit(False))).over(Window.partitionBy(*keys, "sequence"))
    return steps.withColumn("curve", bends).drop("dx", "dy", "was_sequence", "was_component", "was_bx", "was_by", "was_dx", "was_dy")


def ledger_stops(steps: DataFrame, keys: list[str], stops: Stops | None = None) -> DataFrame:
    """(keys, run, anchor, progress, stop_seconds, unmerged_seconds, actions): stops for steering and the implement.

    Sharp angles stop, between operations too; the implement is switched where work begins and ends, and off at the end of
    a chain. Actions at one place run together: the stop lasts as long as the longest.
    """
    s = stops or Stops()
    way = Window.partitionBy(*keys).orderBy("sequence", "i")
    rows = steps.withColumn("last", F.coalesce(F.lead("breaks").over(way), F.lit(True)))
    was_on = F.col("was_working") & ~F.col("breaks")
    was_on = F.coalesce(was_on, F.lit(False))
    event = lambda when, at, action, seconds: F.when(when, F.struct(F.col(at).alias("at"), F.lit(action).alias("action"), F.lit(float(seconds)).alias("seconds")))
    made = F.array(
        event(F.col("angle") > STEER_DEG, "start_m", "STOP_STEER", s.steer), event(F.col("opens") & F.col("working") & ~was_on, "start_m", "IMPLEMENT_ON", s.switch),
        event(F.col("opens") & ~F.col("working") & was_on, "start_m", "IMPLEMENT_OFF", s.switch), event(F.col("last") & F.col("working"), "end_m", "IMPLEMENT_OFF", s.switch),
    )
    events = rows.select(*keys, "run", F.explode(F.array_compact(made)).alias("e")).select(*keys, "run", F.round(F.col("e.at") / POSITION_EPS_M).cast("long").alias("anchor"), F.col("e.at").alias("at"), "e.action", "e.seconds")
    action = events.groupBy(*keys, "run", "anchor", "action").agg(F.max("seconds").alias("seconds"), F.min("at").alias("at"))
    return action.groupBy(*keys, "run", "anchor").agg(F.min("at").alias("progress"), F.max("seconds").alias("stop_seconds"), F.sum("seconds").alias("unmerged_seconds"), F.array_sort(F.collect_set("action")).alias("actions"))


def geometry_ledger(vertices: DataFrame, keys: list[str], speeds: Speeds | None = None, stops: Stops | None = None) -> DataFrame:
    """One row a key: times of work, driving and stops from the lines alone, with counts, distances, ratio and status.

    Curved work and curved connections go at the lesser of their own and the turning speed. More than one chain leaves a gap
    without a connection, so the ratio is null; so it is where no time is known. Keys without a step have no row.
    """
    v = speeds or Speeds()
    steps = operation_steps(vertices, keys)
    speed = F.when(F.col("working"), F.when(F.col("curve"), F.lit(float(min(v.work, v.turn)))).otherwise(F.lit(float(v.work)))).otherwise(F.when(F.col("curve"), F.lit(float(v.turn))).otherwise(F.lit(float(v.transit))))
    steps = steps.withColumn("seconds", F.col("length") / speed)
    part = lambda cond, what: F.sum(F.when(cond, F.col(what)).otherwise(0.0))
    sums = steps.groupBy(*keys).agg(
        part(F.col("working"), "seconds").alias("t_work"), part(~F.col("working"), "seconds").alias("t_drive"), part(~F.col("working") & F.col("curve"), "seconds").alias("t_turn"),
        part(F.col("working"), "length").alias("work_m"), part(~F.col("working"), "length").alias("connection_m"), F.max("run").alias("chains"),
    )
    held = ledger_stops(steps, keys, stops)
    count = lambda *a: F.sum(F.size(F.array_intersect("actions", F.array(*map(F.lit, a))))).cast("long")
    merged = held.groupBy(*keys).agg(F.sum("stop_seconds").alias("t_stop"), F.count("*").alias("stops"), count("STOP_STEER").alias("steer_stops"), count("IMPLEMENT_ON", "IMPLEMENT_OFF").alias("switches"), F.sum(F.col("unmerged_seconds") - F.col("stop_seconds")).alias("saved_s"))
    met = sums.join(merged, keys, "left").na.fill(0.0, ["t_stop", "saved_s"]).na.fill(0, ["stops", "steer_stops", "switches"])
    total = F.col("t_work") + F.col("t_drive") + F.col("t_stop")
    good = (F.col("chains") == 1) & (total > 0)
    return met.select("*", F.when(good, F.col("t_work") / total).alias("ratio"), F.when(good, F.lit("ESTIMATED")).otherwise(F.lit("INCOMPLETE")).alias("status"))
