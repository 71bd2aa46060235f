"""States of fields in a running batch, as a stream with one small state a field and a timer for work that is lost.

Events (field_id, event, at, error) come in files: SUBMITTED, STARTED, DONE and FAILED. A field is PENDING, RUNNING,
COMPLETED or FAILED. Work that isn't reported `limit` after its start is lost: the timer fails that attempt. A failed field
is PENDING again while it has attempts left. Every change is one row of the output, so the newest row of a field is its
state. The checkpoint holds states and timers: a stream that starts again goes on, and files it has seen are not read again.

An event that isn't newer than the field's last one changes nothing, so repeated files and rows do nothing, nor do events
that don't fit the state (a report of a field that isn't running, a start of one that isn't pending). Null fields, events
or times are left out. Time is the events' own: a timer runs when later events of any field have moved the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "field_id long, event string, at timestamp, error string"
CHANGES = "field_id long, at timestamp, state string, attempts int, reason string"
_STATE = "state string, attempts int, last_ms long, deadline_ms long"


def _ms(at: datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


def changed(state: tuple[str, int] | None, event: str, error: str | None, retries: int) -> tuple[str, int, str | None] | None:
    """(state, attempts, reason) after an event, or None if it doesn't fit."""
    name, attempts = state or ("NEW", 0)
    if event == "SUBMITTED" and name == "NEW":
        return "PENDING", 0, None
    if event == "STARTED" and name == "PENDING":
        return "RUNNING", attempts + 1, None
    if event == "DONE" and name == "RUNNING":
        return "COMPLETED", attempts, None
    if event in ("FAILED", "TIMEOUT") and name == "RUNNING":
        return "PENDING" if attempts <= retries else "FAILED", attempts, error or event
    return None


class FieldStates(StatefulProcessor):
    """Keeps a field's state, number of attempts, last event and deadline."""

    def __init__(self, limit: timedelta, retries: int):
        self.limit_ms, self.retries = int(limit.total_seconds() * 1000), retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def _step(self, field: int, event: str, error: str | None, ms: int) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        if before is not None and event != "TIMEOUT" and ms <= before[2]:
            return
        new = changed(before and (before[0], before[1]), event, error, self.retries)
        if new is None:
            return
        if before is not None and before[3]:
            self.handle.deleteTimer(before[3])
        deadline = ms + self.limit_ms if new[0] == "RUNNING" else 0
        if deadline:
            self.handle.registerTimer(deadline)
        self.state.update((new[0], new[1], ms, deadline))
        yield Row(field_id=field, at=_at(ms), state=new[0], attempts=new[1], reason=new[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: (_ms(r["at"]), r["event"])):
            # a deadline before this event has passed, though its timer may run later
            before = self.state.get() if self.state.exists() else None
            if before is not None and before[3] and before[3] < _ms(row["at"]):
                yield from self._step(key[0], "TIMEOUT", None, before[3])
            yield from self._step(key[0], row["event"], row["error"], _ms(row["at"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        if before is not None and before[3] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._step(key[0], "TIMEOUT", None, before[3])

    def close(self) -> None:
        pass


def field_changes(events: DataFrame, limit: timedelta = timedelta(minutes=30), retries: int = 1) -> DataFrame:
    """All changes of state of a stream of events. The session's state store must be RocksDB's."""
    good = events.where("field_id is not null and event is not null and at is not null").withWatermark("at", "0 seconds")
    return good.groupBy("field_id").transformWithState(FieldStates(limit, retries), CHANGES, "append", "eventTime")


def newest_states(changes: DataFrame) -> DataFrame:
    """(field_id, state, attempts, reason) from the table of all changes."""
    last = changes.groupBy("field_id").agg(F.max_by(F.struct("state", "attempts", "reason"), F.struct("at", "attempts", F.col("state") != "RUNNING")).alias("s"))
    return last.select("field_id", "s.*")
