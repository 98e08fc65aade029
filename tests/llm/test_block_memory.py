"""What a task of the block operators holds, and that slices and stretches don't show in results."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import blocks as bl
from siltstone.llm import language_model as lm


class Asked:
    """Stands for requests; keeps the function that adds a shard up."""

    def groupBy(self, *_):  # noqa: N802
        return self

    def applyInArrow(self, function, _):  # noqa: N802
        self.function = function
        return self


def peak(function):
    tracemalloc.start()
    try:
        return function(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("width", [8, 5])
def test_a_shard_adds_up_in_little_memory(width):
    rng, rows, n = np.random.default_rng(7), 300, 4000
    pool = rng.integers(0, 1 << 40, rows * n // 3).astype("<u8")
    keys = [np.unique(pool[rng.integers(0, len(pool), n)]) for _ in range(rows)]
    counts = [rng.integers(0, 3, len(k)).astype("<u4") for k in keys]
    counts[0][:] = counts[1][:] = 2**32 - 1
    cut = [np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() for k in keys]
    table = pa.table({"shard": pa.array([3] * rows, pa.int32()), "block_id": pa.array(range(rows), pa.int64()), "keys": pa.array(cut, pa.binary()), "counts": pa.array([c.tobytes() for c in counts], pa.binary())})
    table = pa.concat_tables([table.slice(0, 100), table.slice(100, 1), table.slice(101)])
    got, most = peak(lambda: bl.answers(Asked(), width, bl.packed_counts).function(table))
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(sums, inverse, np.concatenate(counts).astype(np.int64))
    ends = np.cumsum([0, *map(len, keys)])
    assert got.column("block_id").to_pylist() == list(range(rows)) and set(got.column("shard").to_pylist()) == {3}
    for i, x in enumerate(got.column("counts").to_pylist()):
        assert np.array_equal(np.frombuffer(x, "<u4"), np.minimum(sums[inverse[ends[i] : ends[i + 1]]], 2**32 - 1))
    assert sum(got.column("total").to_pylist()) == sums.sum() and sum(got.column("distinct_keys").to_pylist()) == (sums > 0).sum()
    assert most < 48 * ends[-1]  # bytes a key


def _answered(block, order):
    """The answers to a block that is the whole corpus; the number of tokens and of distinct ones."""
    levels, first, doc = lm.grams(block, order)
    rows, total, distinct = [], 0, 0
    for m, g in enumerate(levels):
        used = ~block.flags[doc] & (g.at >= 0) & (True if m else ~first)
        counts = np.bincount(g.key[g.at[used]], minlength=len(g.keys))
        total, distinct = (total, distinct) if m else (int(counts.sum()), int((counts > 0).sum()))
        asked = bl.requests(0, g.keys, counts, 16, 8, base=m * lm._ORDER)
        rows.append(pa.table({"shard": asked.column("shard"), "counts": asked.column("counts")}))
    return pa.concat_tables(rows), total, distinct


def _block(docs, length, words):
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 2 * length, docs)
    lengths[3] = 0
    ids = np.append(np.arange(words), rng.integers(0, words, int(lengths.sum())))[: int(lengths.sum())].astype(np.uint32)
    return bl.Block(0, pa.array(range(docs)), np.arange(docs) % 5 == 1, lengths, ids, [b"w%d" % i for i in range(words)])


def test_a_block_is_scored_in_little_memory():
    block = _block(300, 1000, 20000)
    right, total, distinct = _answered(block, 2)
    got, most = peak(lambda: lm._scored(block, right, 16, lm.Smoothing(), total, distinct))
    assert got.num_rows == 300
    assert most < 200 * len(block.ids)  # bytes a token; all arcs in one dictionary take more


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stretches_do_not_show_in_scores(order):
    block = _block(40, 30, 50)
    right, total, distinct = _answered(block, order)
    levels, first, _ = lm.grams(block, order)
    counts = [bl.answered(right, m * lm._ORDER, np.diff(bl.shard_starts(g.keys, 16)), bits=False)[g.key] for m, g in enumerate(levels)]
    automaton = lm.Automaton(levels, counts, total, distinct, 2.5)
    bounds = np.append(np.flatnonzero(first), len(first)).tolist()
    whole = automaton.scores(bounds, len(first))
    assert len(whole) == 40
    for stretch in (1, 7, 61):
        assert automaton.scores(bounds, stretch) == whole
