"""The pipeline's stages keep the documents' columns and do what they say."""

import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, simhash, toxicity
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def similar_groups(rows):
    """The doc_ids that stay of near copies, by all pairs."""
    sets = [set(simhash.shingle_set(simhash.words(t), 5).tolist()) for _, t in rows]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b) if a or b else True
    label = brute.groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if like(sets[i], sets[j])])
    return {rows[i][0] for i in set(label)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_each_stage_equals_a_plain_one(spark):
    """Each stage on what the one before it kept; run() packs what the last of them keeps."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept, rows = docs.columns, [], []
    pairs = lambda d: sorted((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows.append(pairs(docs))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        rows.append(pairs(docs))
    kept = [{d for d, _ in r} for r in rows]

    # toxicity: a model trained in this process on the labelled texts that may be learned from
    fit = toxicity.Fit()
    usable = [(t, d) for d, t in rows[0] if zlib.crc32(str(d).encode()) % 3 != 1 and labels.get(d) in (0, 1) and t is not None and len(t.encode()) <= fit.most_bytes]
    # every labelled document is in the sample here; its order is by doc_id within a label
    model = toxicity.train([(t.encode(), y) for y in (0, 1) for t, d in sorted(usable, key=lambda p: p[1]) if labels[d] == y], fit)
    assert isinstance(model, toxicity.Model)
    savings = toxicity.Savings(model.toxic, model.ordinary, fit)
    score = {d: 1 / (1 + np.exp(-(np.append(savings((t or "").encode()), 1) @ np.array(model.weights)))) for d, t in rows[0]}
    assert kept[1] == {d for d, p in score.items() if p < fit.threshold}
    assert kept[2] == {d for d, r in brute.dedup(rows[1]).items() if r[2]} and len(rows[2]) == len(kept[2])
    assert kept[3] == similar_groups(rows[2]) and len(rows[3]) == len(kept[3])

    # mixing: whole documents, each at most twice, each source within a document of its target
    copies = Counter(d for d, _ in rows[4])
    assert kept[4] <= kept[3] and max(copies.values()) <= 2
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    before = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.col("doc_id").isin(list(kept[3])))
    size = {d: len(brute.WORD.findall(t or "")) for d, t in rows[3]}
    target = {r["source"]: r["target"] for r in mixing.mixed(before, mixing.Mix()).collect()}
    longest, words = Counter(), Counter()
    for r in before.select("doc_id", "source").collect():
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
        words[r["source"]] += copies[r["doc_id"]] * size[r["doc_id"]]
    assert set(source.values()) == {s for s, t in target.items() if t > 0 or s in source.values()}
    assert all(abs(words[s] - t) <= longest[s] + 3 * mixing.Mix().block_words for s, t in target.items())

    # packing: every copy's tokens once
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = dict(zip((d for d, _ in rows[3]), map(len, brute.encode(path, [t for _, t in rows[3]]))))
    packed = Counter()
    for r in corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg(F.sum("length").alias("n")).collect():
        packed[r["doc_id"]] = r["n"]
    assert packed == Counter({d: n * tokens[d] for d, n in copies.items()})


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11))
