"""Near copies of every length are found: nothing depends on how fingerprints of words fall."""

import random

import pytest

from siltstone.llm import simhash
from tests.llm import brute


def planted() -> list[tuple[int, str]]:
    r = random.Random(11)
    vocabulary = [f"w{i:x}" for i in range(4000)]
    line = " ".join(r.choice(vocabulary) for _ in range(40))
    out = []
    for n in [8] * 60 + [10] * 30 + [14] * 20 + [30] * 20 + [120] * 10 + [600] * 5:
        w = r.sample(vocabulary, n)
        out += [" ".join(w), " ".join([*w, r.choice(vocabulary)])]  # one word more
        if n >= 50:  # words changed at the end and the start: 0.8 or a little more
            k = n // 10 - 4
            out.append(" ".join([*(r.choice(vocabulary) for _ in range(k)), *w[k:]]))
    out += [f"{line} {r.choice(vocabulary)}" for _ in range(40)]  # one common line makes most of the text
    out += [f"{' '.join(r.sample(vocabulary, 60))} {line}" for _ in range(40)]
    r.shuffle(out)
    return list(enumerate(out))


def best(rows: list[tuple[int, str]]) -> tuple[set[int], list[tuple[int, int]]]:
    """What all pairs give: the doc_ids that stay, and the pairs."""
    sets = [set(simhash.shingle_set(simhash.words(t), 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return set(brute.groups(len(rows), pairs)), pairs


@pytest.mark.parametrize("least", [20, 3, 10**6])
def test_near_copies_of_all_lengths(spark, monkeypatch, least):
    """Whether many shingles count as common, few or none."""
    monkeypatch.setattr(simhash, "COMMON_LEAST", least)
    rows = planted()
    want, pairs = best(rows)
    assert len(pairs) > 900
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_prefixes_of_similar_sets_meet():
    r = random.Random(4)
    for _ in range(2000):
        a = set(r.sample(range(10**6), r.randrange(1, 80)))
        b = set(r.sample(sorted(a), max(1, len(a) - r.randrange(8)))) | {r.randrange(10**6) for _ in range(r.randrange(4))}
        if len(a & b) >= 0.8 * len(a | b):
            first = lambda s: set(sorted(s)[: simhash.prefix_length(len(s), 0.8)])
            assert first(a) & first(b)
