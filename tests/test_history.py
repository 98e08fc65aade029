"""Versions, commits and canonical JSON against plain loops and the standard library."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import canonical_json
from siltstone.operators import history

START = datetime(2024, 1, 1)


def test_edits_apply_one_after_another(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "hot", "hot"]), i, r.choice([1, 1, 2, 3, 4, None]), "x") for i in range(200)] + [(None, 1, 1, "x"), ("a", None, 1, "x")]
    r.shuffle(rows)
    got = history.versioned(spark.createDataFrame(rows, "key string, seq int, expected int, fact string").repartition(3)).collect()
    version, want = {}, []
    for key, seq, expected, fact in sorted((x for x in rows if None not in x[:2]), key=lambda x: x[1]):
        now = version.setdefault(key, 1)
        version[key] = now + (expected == now)
        want.append((key, seq, expected, fact, "EDITED" if expected == now else "CONFLICT", version[key]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len({x[4] for x in want}) == 2
    assert history.versioned(spark.createDataFrame([], "key string, seq int, expected int")).count() == 0


def test_states_as_of_a_time(spark):
    r = random.Random(3)
    states = [(k, n + 1, START + timedelta(hours=r.randrange(20)), r.choice([None, "p", "q"])) for k in "abc" for n in range(r.randrange(1, 9))]
    asked = [(r.choice(["a", "b", "c", "none", None]), START + timedelta(hours=r.randrange(-2, 24)) if r.random() < 0.95 else None, i) for i in range(150)]
    held = history.revisions(spark.createDataFrame(states, "key string, version long, at timestamp, fact string"), ["fact"])
    rows = held.collect()
    for k in "abc":
        own = sorted((x for x in rows if x.key == k), key=lambda x: x.version)
        assert [x.valid_to for x in own] == [x.valid_from for x in own[1:]] + [None]
        assert [x.before for x in own] == [None] + [x.after for x in own[:-1]] and all(a.valid_from <= b.valid_from for a, b in zip(own, own[1:], strict=False))
    got = {x.n: x for x in history.as_of(held, spark.createDataFrame(asked, "key string, at timestamp, n int")).collect()}
    assert len(got) == len(asked)
    for key, at, n in asked:
        then = [x for x in rows if x.key == key and at is not None and x.valid_from <= at]
        last = max(then, key=lambda x: x.version, default=None)
        assert (got[n].version, got[n].state) == ((last.version, last.after) if last else (None, None))


def plain_commits(requests, states, log):
    """Requests one after another against the states, which change with each commit that inserts rows."""
    states, log, out = dict(states), dict(log), {}
    for seq, digest, scope, expected, late, blocked, skip, new in sorted(requests):
        if digest in log:
            out[seq] = ("REPEATED", log[digest])
        elif late:
            out[seq] = ("EXPIRED", 0)
        elif blocked and not skip:
            out[seq] = ("BLOCKED", 0)
        elif states.get(scope) != expected:
            out[seq] = ("STALE", 0)
        elif skip and not new:
            out[seq] = ("NO_VALID_ROWS", 0)
        else:
            out[seq] = ("COMMITTED", new)
            log[digest] = new
            if new:
                states[scope] = f"after {seq}"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_commits_compare_and_set(spark, seed):
    r = random.Random(seed)
    scopes = {"s": "1", "t": "2", "u": "3"}
    staged = [(f"d{i}", r.choice([*scopes, "none"]), r.choice(["1", "2", "3", None]), r.random() < 0.1, r.choice([0, 0, 0, 2]), r.random() < 0.3, r.choice([0, 0, 4])) for i in range(40)]
    requests = [(seq, *r.choice(staged)) for seq in range(120)]
    log = {"d1": 9, "d2": 0}
    rows = [(q[0], q[1], q[2], q[3], START if q[4] else START + timedelta(days=2), q[5], q[6], q[7]) for q in requests]
    df = spark.createDataFrame(rows, "seq int, digest string, scope string, expected string, expires_at timestamp, blocked int, skip boolean, new int")
    got = history.compare_and_set(df, spark.createDataFrame(list(scopes.items()), "scope string, fingerprint string"), spark.createDataFrame(list(log.items()), "digest string, inserted int"), F.lit(START + timedelta(days=1)))
    assert {x.seq: (x.outcome, x.inserted) for x in got.collect()} == plain_commits(requests, scopes, log)


def nested(r, depth=0):
    pick = r.random()
    if depth > 4 or pick < 0.4:
        return r.choice([None, True, 0, -7, 2.5, 1e300, 10**25, "", "é\x7f\x00\"\\/", "🙂 ", "plain"])
    if pick < 0.6:
        return [nested(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["b", "a", "é", "🙂", "￿", "Token_x", "my-HASH", "z" * r.randrange(3)]): nested(r, depth + 1) for _ in range(r.randrange(5))}


def plain_redacted(x):
    if isinstance(x, dict):
        return {k: "[REDACTED]" if any(m in k.lower() for m in ("password", "hash", "token", "csrf", "secret")) else plain_redacted(v) for k, v in x.items()}
    return [plain_redacted(v) for v in x] if isinstance(x, list) else x


def test_canonical_json(spark):
    r = random.Random(5)
    values = [nested(r) for _ in range(300)]
    texts = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=r.choice([None, 2]))) for i, v in enumerate(values)] + [(1000, "{bad"), (1001, None), (1002, '{"a": 1, "a": 2}')]
    c = F.col("t")
    got = {x.i: x for x in spark.createDataFrame(texts, "i int, t string").select("i", canonical_json.canonical(c).alias("plain"), canonical_json.canonical(c, ascii_only=True).alias("ascii"), canonical_json.redacted(c).alias("redacted")).collect()}
    dump = lambda v, a: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=a)
    for i, v in enumerate(values):
        assert (got[i].plain, got[i].ascii, got[i].redacted) == (dump(v, False), dump(v, True), dump(plain_redacted(v), False))
    assert [got[i].plain for i in (1000, 1001, 1002)] == [None, None, '{"a":2}']


def test_digests_leave_python_without_the_texts(spark):
    texts = ['{"b": "é", "a": 1}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", canonical_json.digest(F.col("t")).alias("d"), canonical_json.digest(F.col("t"), ascii_only=True).alias("a"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "ArrowEvalPython" in plan
    want = [hashlib.sha256(x).hexdigest() for x in ('{"a":1,"b":"é"}'.encode(), rb'{"a":1,"b":"\u00e9"}')]
    assert [(r.d, r.a) for r in df.orderBy("i").collect()] == [tuple(want), (None, None), (None, None)]


def test_canonical_json_of_variants(spark):
    row = spark.sql("""SELECT parse_json('{"b": [1, {"z": null, "a": "é"}], "a": {"Secret": 1}}') AS v""").select(canonical_json.canonical(F.to_json("v")).alias("c"), canonical_json.redacted(F.to_json("v")).alias("r")).first()
    assert tuple(row) == ('{"a":{"Secret":1},"b":[1,{"a":"é","z":null}]}', '{"a":{"Secret":"[REDACTED]"},"b":[1,{"a":"é","z":null}]}')
