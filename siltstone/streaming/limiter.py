"""Failure limiter and latest state as Structured Streaming queries with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOCKS = "key long, ts timestamp, seq long, streak long, locked boolean, locked_until timestamp"
STATE = "last timestamp, streak long, cleared boolean"


def failure_locks(attempts: DataFrame, gap_seconds: float, failures: int = 5, lock_seconds: float = 300) -> DataFrame:
    """The streaming form of ``operators.sync.failure_locks``: attempts (key, ts, seq, failure, success) in, locks out.

    State is the last attempt's time, the streak and whether it was cleared; rows of a micro-batch are taken in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak, cleared = state.get if state.exists else (None, 0, True)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for r in rows.itertuples():
            if not (r.failure or r.success):
                continue
            if cleared or last is None or (r.ts - pd.Timestamp(last)).total_seconds() >= gap_seconds:
                streak = 0
            cleared, last = bool(r.success), r.ts
            if r.failure:
                streak += 1
                out.append((key[0], r.ts, r.seq, streak, streak >= failures, r.ts + pd.Timedelta(seconds=lock_seconds) if streak >= failures else None))
        state.update((last, streak, cleared))
        yield pd.DataFrame(out, columns=["key", "ts", "seq", "streak", "locked", "locked_until"])

    return attempts.groupBy("key").applyInPandasWithState(step, LOCKS, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame, key: str, version: str, *facts: str) -> DataFrame:
    """The newest version of each key and its facts, as an aggregation whose state outlives late and repeated rows."""
    from pyspark.sql import functions as F

    return events.groupBy(key).agg(F.max(F.struct(version, *facts)).alias("_s")).select(key, "_s.*")


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Replays dropped: the first row of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
