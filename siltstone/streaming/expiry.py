"""Things that are opened, and expire unless they are closed in time, as a stream with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "id long, status string, at timestamp"


def _ms(t: datetime) -> int:
    return round(t.replace(tzinfo=t.tzinfo or timezone.utc).timestamp() * 1000)


class Expiry(StatefulProcessor):
    """State of an id: when it is due and when it was closed, until both are known or its timer fires."""

    def __init__(self, life: timedelta) -> None:
        self.life = life // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due long, closed long")

    def _out(self, key: tuple, status: str, at: int) -> Row:
        return Row(id=key[0], status=status, at=datetime.fromtimestamp(at / 1000, timezone.utc).replace(tzinfo=None))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.held.get()
        due, closed = before if before else (None, None)
        armed = due
        for r in rows:
            at = _ms(r["ts"])
            if r["opened"]:
                due = min(at + self.life, due or at + self.life)
            else:
                closed = min(at, closed or at)
        if armed and (closed is not None or armed != due):
            self.handle.deleteTimer(armed)
        if due is not None and closed is not None:
            if before:
                self.held.clear()
            yield self._out(key, "closed", closed) if closed < due else self._out(key, "expired", due)
            return
        if due is not None and armed != due:
            self.handle.registerTimer(due)
        self.held.update((due, closed))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        yield self._out(key, "expired", expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def expiries(events: DataFrame, life: timedelta, delay: str = "0 seconds") -> DataFrame:
    """id, status (closed or expired), at: the end of each id. events: id, ts, opened (else closed).

    An id is closed if that happens before it is due; else it expires then, also if no event of it ever comes again, as
    soon as the watermark (the newest event less ``delay``) has reached that time. Closings may come before openings. Rows
    repeated in a batch count once; an id that is opened after its end starts anew.
    """
    return events.withWatermark("ts", delay).groupBy("id").transformWithState(Expiry(life), OUTCOMES, "append", "eventTime")
