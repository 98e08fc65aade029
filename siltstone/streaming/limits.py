"""A limiter of failing clients that keeps a bounded number of them, as a batch and as a stream.

Clients are dealt by hash to shards, each with its own places. A shard forgets clients that have been idle for a window,
oldest first, and when a new one needs a place, the one whose last failure is longest ago. Attempts reach a task sorted by
Spark (which spills), so a task holds a shard's places and one batch of rows, however many attempts a client has.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import scratch

#: An attempt and what came of it, or (outcome null) a place held at the end: ts of its last failure, seq its rank from the longest ago.
OUTCOMES = "shard int, client string, ts timestamp, seq long, outcome string, failures long, locked_until timestamp, held long"


@dataclass(frozen=True)
class Limits:
    failures: int = 5
    """From how many on a client is locked."""
    lock: timedelta = timedelta(minutes=5)
    window: timedelta = timedelta(minutes=5)
    clients: int = 10_000
    """Places of a shard."""
    shards: int = 64


class Places:
    """A shard's clients, longest idle first: failures, last failure and end of the lock, in microseconds."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.window, self.lock = (x // timedelta(microseconds=1) for x in (limits.window, limits.lock))
        self.held: OrderedDict[str, tuple[int, int, int | None]] = OrderedDict()

    def attempt(self, client: str, at: int, failure: bool) -> tuple[str, int, int | None]:
        """Outcome (LIMITED, OK, FAILED, LOCKED), failures and end of the lock."""
        while self.held:
            oldest, (_, last, until) = next(iter(self.held.items()))
            if at - last < self.window or (until is not None and until > at):
                break
            del self.held[oldest]
        n, _, until = self.held.get(client, (0, 0, None))
        if until is not None:
            if until > at:
                return "LIMITED", n, until
            n = 0
            del self.held[client]
        if not failure:
            self.held.pop(client, None)
            return "OK", 0, None
        if client in self.held:
            del self.held[client]
        else:
            while len(self.held) >= self.limits.clients:
                self.held.popitem(last=False)
        until = at + self.lock if n + 1 >= self.limits.failures else None
        self.held[client] = (n + 1, at, until)
        return ("LOCKED" if until else "FAILED"), n + 1, until


def limited(attempts: DataFrame, limits: Limits = Limits(), places: DataFrame | None = None) -> DataFrame:
    """OUTCOMES of attempts (client, ts, seq, failure) in order of ts and seq, after ``places``, rows of an earlier result.

    Attempts without client or time are left out; a null failure counts as a success.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shard = F.pmod(F.xxhash64(F.col("client").cast("string")), F.lit(limits.shards)).cast("int")
    none = F.lit(None).cast("long")
    rows = attempts.filter("client IS NOT NULL AND ts IS NOT NULL").select(
        shard.alias("shard"), F.lit(1).alias("kind"), us("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("client").cast("string").alias("client"), F.coalesce("failure", F.lit(False)).alias("failure"), none.alias("last"), none.alias("failures"), none.alias("until")
    )
    if places is not None:
        before = places.filter("outcome IS NULL").select("shard", F.lit(0).alias("kind"), none.alias("at"), "seq", "client", F.lit(False).alias("failure"), us("ts").alias("last"), "failures", us("locked_until").alias("until"))
        rows = rows.unionByName(before)
    rows = rows.repartition(limits.shards, "shard").sortWithinPartitions("shard", "kind", "at", "seq")
    stamp = pa.timestamp("us", "UTC")
    kinds = (pa.int32(), pa.string(), stamp, pa.int64(), pa.string(), pa.int64(), stamp, pa.int64())
    names = ["shard", "client", "ts", "seq", "outcome", "failures", "locked_until", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Places(limits)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) if k == stamp else pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def left() -> list[tuple]:
            return [(now, c, last, i, None, n, until, len(own.held)) for i, (c, (n, last, until)) in enumerate(own.held.items())]

        for b in batches:
            out: list[tuple] = []
            for shard, kind, at, seq, client, failure, last, n, until in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now:
                    out += left()
                    now, own = shard, Places(limits)
                if kind:
                    outcome, n, until = own.attempt(client, at, failure)
                    out.append((shard, client, at, seq, outcome, n, until, len(own.held)))
                else:
                    own.held[client] = (n, last, until)
            if out:
                yield batch(out)
        if own.held:
            yield batch(left())

    return rows.mapInArrow(run, OUTCOMES)


class LimitStream:
    """Attempts of a stream, batch after batch; an epoch's folder holds its outcomes and the places that it leaves.

    An epoch that runs again writes its folder again, from the places of the one before, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, folder: str, limits: Limits = Limits()) -> None:
        self.spark, self.folder, self.limits = spark, folder, limits

    def _of(self, epoch: int) -> str:
        return f"{self.folder}/epoch={epoch}"

    def _save(self, attempts: DataFrame, epoch: int) -> None:
        before = None if epoch == 0 else attempts.sparkSession.read.schema(OUTCOMES).parquet(self._of(epoch - 1))
        limited(attempts, self.limits, before).write.mode("overwrite").parquet(self._of(epoch))

    def start(self, attempts: DataFrame, checkpoint: str):
        return attempts.writeStream.foreachBatch(self._save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(f"{OUTCOMES}, epoch long").parquet(self.folder).filter("outcome IS NOT NULL").drop("epoch")


def drained(spark: SparkSession, attempts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The outcomes of a stream of attempts, run to its end."""
    stream = LimitStream(spark, scratch.folder(spark, "limits"), limits)
    stream.start(attempts, scratch.folder(spark, "limits-checkpoint")).awaitTermination()
    return stream.outcomes()
