"""Streams with timers and bounded state against plain loops."""

import random
from datetime import datetime, timedelta


from siltstone.streaming import expiry, limits
from siltstone.streaming.queries import _ROCKS, _drained

START = datetime(2024, 1, 1)


def streamed(spark, folder, batches, schema):
    """A stream that delivers each batch as a micro-batch of its own."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        for part in (folder / str(i)).glob("part-*.parquet"):
            part.rename(folder / f"{i:03d}.parquet")
            (folder / f"{i:03d}.parquet").touch()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "[0-9][0-9][0-9].parquet").parquet(str(folder))


def test_expiries_come_without_another_event(spark, tmp_path):
    r = random.Random(2)
    life, events = 900, []
    for i in range(60):
        at = r.randrange(3000)
        events.append((i, at, True))
        if i % 3:
            events.append((i, at + r.randrange(-30, 1800), False))
    events += [events[0], (100, 5000, True)]
    events.sort(key=lambda e: e[1])
    rows = [(i, START + timedelta(seconds=t), o) for i, t, o in events]
    until, want = 5000, {}
    for i in {e[0] for e in events}:
        opened = min(t for j, t, o in events if j == i and o)
        closed = min((t for j, t, o in events if j == i and not o), default=None)
        if closed is not None and closed < opened + life:
            want[i] = ("closed", closed)
        elif closed is not None or opened + life <= until:
            want[i] = ("expired", opened + life)
    stream = streamed(spark, tmp_path, [rows[:40], rows[40:70], rows[70:]], "id long, ts timestamp, opened boolean")
    got = _drained(spark, expiry.expiries(stream, timedelta(seconds=life), "40 seconds"), "test-expiries", _ROCKS).collect()
    assert len(got) == len({x.id for x in got})
    late = until - 40  # the watermark at the end
    assert {x.id: (x.status, round((x.at - START).total_seconds())) for x in got} == {i: x for i, x in want.items() if x[0] == "closed" or x[1] <= late or any(j == i and not o for j, _, o in events)}


def plain_limits(attempts, most):
    """Outcomes of one shard; a list of (client, failures, last, until), longest idle first."""
    held, out = [], []
    for client, at, seq, failure in sorted(attempts, key=lambda a: (a[1], a[2])):
        while held and at - held[0][2] >= 300 and not (held[0][3] and held[0][3] > at):
            held.pop(0)
        own = [h for h in held if h[0] == client]
        if own and own[0][3] and own[0][3] > at:
            out.append((client, seq, "LIMITED", own[0][1]))
            continue
        held = [h for h in held if h[0] != client]
        if not failure:
            out.append((client, seq, "OK", 0))
            continue
        n = (own[0][1] if own and not own[0][3] else 0) + 1
        held = held[max(0, len(held) - most + 1) :] if not own or own[0][3] else held
        held.append((client, n, at, at + 300 if n >= 5 else None))
        out.append((client, seq, "LOCKED" if n >= 5 else "FAILED", n))
    return out, len(held)


def some_attempts():
    r = random.Random(6)
    rows, at = [], 0
    for i in range(900):
        at += r.choice([0, 1, 5, 30, 200])
        rows.append((r.choice(["a", "b", "c", "hot", "hot", f"x{r.randrange(40)}"]), at, i, r.random() < 0.9))
    return rows


def test_limiter_keeps_a_bounded_number_of_clients(spark, tmp_path):
    rows = some_attempts()
    said = [(c, START + timedelta(seconds=t), s, f) for c, t, s, f in rows] + [(None, START, 1, True), ("a", None, 2, True)]
    schema = "client string, ts timestamp, seq long, failure boolean"
    few = limits.Limits(clients=4, shards=3)
    got = limits.limited(spark.createDataFrame(said, schema).repartition(4), few).collect()
    shard = {x.client: x.shard for x in got}
    want = []
    for k in set(shard.values()):
        out, held = plain_limits([a for a in rows if shard[a[0]] == k], 4)
        want += out
        assert sum(x.outcome is None and x.shard == k for x in got) == held <= 4
    assert sorted((x.client, x.seq, x.outcome, x.failures) for x in got if x.outcome) == sorted(want)
    assert max(x.held for x in got) <= 4 and "LIMITED" in {x[2] for x in want}
    # the same from a stream, its places handed from batch to batch
    cut = sorted(said[:900], key=lambda a: (a[1], a[2]))
    stream = streamed(spark, tmp_path, [cut[:300], cut[300:301], cut[301:]], schema)
    again = limits.drained(spark, stream, few).collect()
    assert sorted((x.client, x.seq, x.outcome, x.failures) for x in again) == sorted(want)


def test_limiter_of_nothing(spark):
    assert limits.limited(spark.createDataFrame([], "client string, ts timestamp, seq long, failure boolean")).count() == 0
    one = limits.limited(spark.createDataFrame([("a", START, 1, None)], "client string, ts timestamp, seq long, failure boolean")).collect()
    assert [(x.outcome, x.held) for x in one] == [("OK", 0)]
