"""Filter audit, decontamination and source divergence against plain versions, on tables with edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import decontaminate, divergence, filter_audit
from tests.llm.brute import lower
from tests.llm.test_operators import ROWS, SCHEMA, WORDS, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(ROWS) if i % 3] + [(ROWS[1][0], 1, 1), (ROWS[1][0], 0, 0), (None, 1, 1), (99, 1, 1), (ROWS[4][0], None, None)]
#: Rows of one doc_id, repeated rows, and rows without doc_id, text or language.
ODD = [ROWS[0], ROWS[0], (None, *ROWS[0][1:]), (None, *ROWS[0][1:]), (None, None, None, None, None, *ROWS[0][5:]), (ROWS[1][0], ROWS[0][1], "", "hot", *ROWS[0][4:]), (5, "A# " * 200, "fr", "", *ROWS[0][4:]), (6, "A# " * 200, "fr", "", *ROWS[0][4:])]
LONG = [(7, " ".join(f"{a}{i}" for i, a in enumerate(random.Random(1).choices(WORDS, k=40000))), "en", "src1", *ROWS[0][4:]), (8, "x" * 300_000, "en", "src1", *ROWS[0][4:])]


@pytest.fixture(scope="module")
def tables(spark):
    return {name: (rows, spark.createDataFrame(rows, SCHEMA).repartition(5)) for name, rows in (("whole", ROWS + ODD + LONG), ("odd", ODD), ("nothing", []))}


def plain_audit(rows):
    good = {d for d, q, _ in LABELS if q == 1 and d is not None}
    toxic = {d for d, _, t in LABELS if t == 1 and d is not None}
    failed = []
    for d, text, lang, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": copy}
        failed.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {f[0] for f in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for i, x in enumerate(order):
                here = [f for f in own if x in f[0] and not f[0] & set(order[:i])]
                kept = sum(not f[0] & set(order[: i + 1]) for f in own)
                out[part, order, i + 1] = (kept, len(here), sum(x in f[0] for f in own) - len(here), sum(f[0] == {x} for f in own), sum(f[1] for f in here), sum(f[2] for f in here))
                shapley[part, x] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("name", ["whole", "odd", "nothing"])
def test_filter_audit(spark, tables, name):
    rows, docs = tables[name]
    labels = spark.createDataFrame([(*x, "extra", "extra") for x in LABELS], "doc_id long, quality int, toxic int, part string, mask string")
    got = filter_audit.audit(docs.withColumnRenamed("score", "mask").withColumnRenamed("slot", "part"), labels).collect()
    values = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert len(got) == len(set((r["part"], r["filter_order"], r["step"]) for r in got))
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in values) for r in got} == plain_audit(rows)


def test_filter_audit_without_labels(spark, tables):
    got = filter_audit.audit(tables["odd"][1], spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(got) == (0, 0)


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def plain_hits(rows, items, window=10):
    """For each row: words, hit places, items."""
    grams = defaultdict(set)
    for item, text in items:
        w = norm(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            grams[tuple(w[i : i + n])].add(None if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for text in rows:
        w = norm(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out.append((len(w), hit, found - {None}))
    return out


def contaminated(seed):
    """Few words, so that runs overlap in many ways."""
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "Ba", "é", "7"])
    items = [(i, r.choice([" ", "-", "\n"]).join(word() for _ in range(r.choice([1, 3, 7, 9, 10, 11, 25, 60])))) for i in range(3, 25)]
    items = [x for x in items if len(norm(x[1])) > 2]
    items += [(3, "again a b a b a b a b a b a b"), (None, "q r s t"), (100, "q r s t"), (101, None), (102, "... !"), (103, " ".join(f"w{i}" for i in range(40)))]
    texts = [" ".join(r.choice([word(), word(), "zz", r.choice(items)[1] or ""]) for _ in range(n)) for n in [0, 1, 5, 30, 200] * 8]
    texts += [None, "", "q, R; s\tt!", "w3 w4 w5 w6 w7 w8 w9 w10 w11", "w3 w4 w5 w6 w7 w8 w9 w10 w11 W12", "x w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 x w30 w31 w32 w33 w34 w35 w36 w37 w38 w39", "İK q r s t", " ".join(f"w{i % 40}" for i in range(30_000))]
    return items, texts


@pytest.mark.parametrize("shard_words,piece_words", [(1 << 18, 1 << 14), (60, 12), (1000, 20)])
def test_decontamination(spark, monkeypatch, shard_words, piece_words):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece_words)
    items, texts = contaminated(shard_words)
    docs = spark.createDataFrame([(i, t, "s", 1, "f") for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_words int, _file string").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n int")
    got = {r["doc_id"]: r for r in decontaminate.hits(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, (n, hit, found) in enumerate(plain_hits(texts, items)):
        r = got[i]
        places = [p for s in r["spans"] for p in range(s["first"], s["first"] + s["words"])]
        assert (r["n_words"], places, r["items"]) == (n, sorted(hit), sorted(found)), texts[i]
        for s in r["spans"]:
            assert norm(texts[i][s["start"] : s["end"]]) == norm(texts[i])[s["first"] : s["first"] + s["words"]]
            assert texts[i][s["start"]].strip() and texts[i][s["end"] - 1].strip()


def test_decontaminated_texts(spark):
    item = " ".join(f"w{i}" for i in range(30))
    texts = {1: "é before, " + item.upper() + "! after it come " + "other words " * 40, 2: item, 3: None, 4: "clean 🙂 text", 5: "🙂 x " + " ".join(f"w{i}" for i in range(5, 15)) + " y" + " z" * 30}
    docs = spark.createDataFrame([(k, 7, t, "k") for k, t in texts.items()], "doc_id long, spans int, text string, items string")
    bench = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: "é before, ! after it come " + "other words " * 40, 3: None, 4: texts[4], 5: "🙂 x  y" + " z" * 30}
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    long_only = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, longest=10, most_coverage=1.0).collect()}
    assert long_only[5] == texts[5] and long_only[2] == "" and long_only[1] == got[1]


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert [(r["n_words"], r["spans"], r["items"]) for r in decontaminate.hits(docs, bench).orderBy("n_words").collect()] == [(0, [], []), (3, [], []), (3, [], [])]
    assert decontaminate.hits(docs.limit(0), spark.createDataFrame([("x", "a b")], "item_id string, text string")).count() == 0


def plain_divergence(rows, least=3, most=200):
    count, docs_in, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add(g)
        count[g].update(w)
        docs_in[g[0]].update(set(w))
    out = []
    for lang in {g[0] for g in groups}:
        terms = {t for t, n in docs_in[lang].items() if n >= least}
        own = sorted(g[1] for g in groups if g[0] == lang)
        of = {s: {t: count[lang, s][t] for t in terms} for s in own}
        whole = {t: sum(of[s][t] for s in own) for t in terms}
        p = lambda c: {t: 1 + 1_000_000_000 * (n + 1) // (sum(c.values()) + len(terms)) for t, n in c.items()}
        shares, q = {s: p(of[s]) for s in own}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = [(-sum(f(shares[s][t], shares[o][t]) for t in terms), o.encode()) for o in own if o != s]
            over = [(-f(shares[s][t], q[t]), t.encode()) for t in terms if of[s][t] and shares[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(over)[:most])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(listed)]
    return sorted(out)


def diverging():
    """Sources of unlike words and sizes, ties, one that has no terms, a language of one source and one without kept terms."""
    r = random.Random(8)
    rows = []
    for i in range(300):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "b", "c", "", None, "é"])
        rows.append((i, " ".join(r.choice(WORDS[: 5 + 6 * (ord((source or "z")[0]) % 4)]).upper() + r.choice(["", ".", "1", "é"]) for _ in range(r.choice([0, 1, 8, 60]))), lang, source))
    rows += [(300 + i, "solo words stay " * 3, "one", "only") for i in range(4)] + [(310, "never often", "rare", "a"), (311, "enough of", "rare", "b"), (312, None, "en", "silent"), (313, "123 !", "en", None)]
    rows += [rows[0]] * 3 + [(400 + i, " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(400)), "many", f"s{i % 2}") for i in range(4)]
    return [(*x, None, 1.0, 5, 6, True, 7, 8, 9, 10, 11) for x in rows]


@pytest.mark.parametrize("block,tally,held", [(256, 1 << 20, 400_000), (2, 50, 30), (1, 1, 1)])
def test_divergence(spark, tables, monkeypatch, block, tally, held):
    for name, value in (("BLOCK", block), ("TALLY", tally), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rows = diverging()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("slot", "term").withColumnRenamed("shard", "n")
    assert sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(rows)


@pytest.mark.parametrize("name", ["whole", "odd", "nothing"])
def test_divergence_of_edges(tables, monkeypatch, name):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)  # joins by shuffle
    rows, docs = tables[name]
    assert sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())) == plain_divergence(rows)


def test_large_counts_are_exact(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(10**15), divergence.F.lit(3 * 10**15), divergence.F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7)
