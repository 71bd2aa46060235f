"""The stream of field states: retries, a lost batch, a repeated file, a restart, against a plain fold."""

from datetime import datetime, timedelta

import pytest

from furrow.streaming import states as S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def folded(events, limit=30, retries=1):
    out = {}
    for f, event, minute, error in sorted(events, key=lambda e: (e[2], e[1])):
        for g in [g for g, s in out.items() if s["due"] is not None and s["due"] < minute]:
            new = S.changed((out[g]["state"], out[g]["n"]), "TIMEOUT", None, retries)
            out[g] = {"state": new[0], "n": new[1], "why": new[2], "last": out[g]["due"], "due": None}
        s = out.get(f)
        if s and minute <= s["last"]:
            continue
        new = S.changed(s and (s["state"], s["n"]), event, error, retries)
        if new:
            out[f] = {"state": new[0], "n": new[1], "why": new[2], "last": minute, "due": minute + limit if new[0] == "RUNNING" else None}
    return {f: (s["state"], s["n"], s["why"]) for f, s in out.items()}


def test_rules():
    assert S.changed(None, "SUBMITTED", None, 1) == ("PENDING", 0, None) and S.changed(None, "DONE", None, 1) is None
    assert S.changed(("RUNNING", 1), "FAILED", "x", 1) == ("PENDING", 1, "x") and S.changed(("RUNNING", 2), "TIMEOUT", None, 1) == ("FAILED", 2, "TIMEOUT")
    assert S.changed(("COMPLETED", 1), "STARTED", None, 1) is None


def test_stream(spark, tmp_path):
    """Field 1 completes, 2 fails and completes, 3 is lost twice, 4 waits, 5 reports without a start; then a restart."""
    first = [(1, "SUBMITTED", 0, None), (2, "SUBMITTED", 0, None), (3, "SUBMITTED", 0, None), (4, "SUBMITTED", 1, None), (1, "STARTED", 2, None), (2, "STARTED", 2, None), (3, "STARTED", 3, None), (5, "DONE", 3, None)]
    second = [(1, "DONE", 10, None), (2, "FAILED", 11, "no way"), (2, "STARTED", 12, None), (2, "DONE", 20, None), (3, "STARTED", 40, None), (None, "DONE", 41, None)]
    third = [(4, "STARTED", 100, None), (4, "DONE", 101, None)]
    fourth = [(6, "SUBMITTED", 200, None)]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def add(events):
        rows = [(f, e, at(m), why) for f, e, m, why in events]
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def go_on():
        stream = S.field_changes(spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return {r.field_id: (r.state, r.attempts, r.reason) for r in S.newest_states(spark.read.parquet(out)).collect()}

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        add(first)
        got = go_on()
        assert got == folded(first) == {1: ("RUNNING", 1, None), 2: ("RUNNING", 1, None), 3: ("RUNNING", 1, None), 4: ("PENDING", 0, None)}
        add(second)
        add(second)  # the same file once more
        got = go_on()
        assert got == folded(first + second) and got[2] == ("COMPLETED", 2, None) and got[3] == ("RUNNING", 2, None)
        add(third)
        add(fourth)
        got = go_on()
        assert got == folded(first + second + third + fourth) and got[3] == ("FAILED", 2, "TIMEOUT") and got[4] == ("COMPLETED", 1, None)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("events", [[], [(1, "DONE", 5, None)]])
def test_folds_of_nothing(events):
    assert folded(events) == {}
