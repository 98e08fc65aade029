"""Scoring by a weighted backoff automaton.

n-grams are counted over all training documents. A context h that occurred c(h) times gives a word w the probability
(c(hw) + k P(w | h')) / (c(h) + k), h' being h without its first word, down to P(w) = (c(w) + 1/2) / (N + (V + 1) / 2):
probabilities sum to one over the vocabulary and one unknown word. Contexts become states; a seen hw is an arc with its
log-probability, and every state has a failure arc to h' with log k / (c(h) + k). A document is traversed once from left
to right, carrying the state and adding up the weights of arcs and failure arcs.

The whole automaton is never in one place: each block of documents learns the counts of its own n-grams from the shards
that add them up over all blocks, and builds the part of the automaton that its documents can reach.

Nulls: a null text is empty (one end token); a null doc_id counts as the text "". Repeated rows count each time. An
empty table gives an empty result; without training documents all counts are zero. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import blocks as bl
from siltstone.llm.storage import written

#: Shards of order m begin at m * _ORDER.
_ORDER = 1 << 24
_WIDTH = 8
#: Places of text whose arcs are in one dictionary.
STRETCH = 1 << 16
#: Of blocks, or of a shard's requests, in an Arrow batch.
_BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Smoothing:
    order: int = 2
    #: Weight of the lower order, in counts.
    k: float = 200.0


@dataclass
class Grams:
    """The distinct m-grams of a block: hash, number of the (m - 1)-gram before its last word and of the one after its first, last word."""

    hashes: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    word: np.ndarray
    #: The gram that ends at each position of the padded text, -1 where it would begin before its document.
    at: np.ndarray
    #: Distinct shard keys, ascending; which of them each gram has.
    keys: np.ndarray
    key: np.ndarray


def padded(block: bl.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers with a boundary word (0) before each document and at its end; whether each place is a document's first; each place's document."""
    n = len(block.lengths)
    begin = block.starts[:-1] + 2 * np.arange(n)
    size = int(block.lengths.sum()) + 2 * n
    edge = np.zeros(size, dtype=bool)
    edge[begin] = edge[begin + block.lengths + 1] = True
    ids = np.zeros(size, dtype=np.int32)
    ids[~edge] = block.ids + 1
    first = np.zeros(size, dtype=bool)
    first[begin] = True
    return ids, first, np.repeat(np.arange(n, dtype=np.int32), block.lengths + 2), [b"", *block.words]


def grams(block: bl.Block, order: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """The m-grams of a block for m = 1 .. order, whether each place is a document's first, and each place's document."""
    ids, first, doc, words = padded(block)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    none = np.full(len(h), -1, dtype=np.int32)
    out = [_keyed(h, none, none, np.arange(len(h), dtype=np.int32), ids)]
    place = np.arange(len(ids), dtype=np.int32)
    since = place - np.maximum.accumulate(np.where(first, place, 0))
    del place, none
    for m in range(2, order + 1):
        low = out[-1]
        ends = np.flatnonzero(since >= m - 1).astype(np.int32)
        codes = low.at[ends - 1].astype(np.int64)
        codes *= len(words)
        codes += ids[ends]
        by = np.argsort(codes, kind="stable").astype(np.int32)
        codes = codes[by]
        new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
        where = np.full(len(ids), -1, dtype=np.int32)
        where[ends[by]] = np.cumsum(new, dtype=np.int32) - 1
        distinct, suffix = codes[new], low.at[ends[by[new]]]
        del ends, by, codes, new
        prefix, word = (distinct // len(words)).astype(np.int32), (distinct % len(words)).astype(np.int32)
        del distinct
        out.append(_keyed(bl.mix(low.hashes[prefix], h[word]), prefix, suffix, word, where))
    return out, first, doc


def _keyed(h: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, word: np.ndarray, at: np.ndarray) -> Grams:
    keys, key = np.unique(h, return_inverse=True)
    return Grams(h, prefix, suffix, word, at, keys, key.astype(np.int32))


class Automaton:
    """The part of the automaton that a block's documents can reach. State 0 is the empty context.

    Arcs are kept as an array of each order, by gram. The text is read a stretch at a time, with a dictionary of those arcs that
    lie on grams of the stretch: no other arc can be taken there.
    """

    def __init__(self, levels: list[Grams], counts: list[np.ndarray], total: int, distinct: int, k: float) -> None:
        self.words, self.levels = len(levels[0].hashes), levels
        p = (counts[0] + 0.5) / (total + 0.5 * (distinct + 1))
        # of each order, by gram: whether it is an arc, its log-probability, where it leads
        self.seen, self.weights, self.targets = [np.ones(self.words, dtype=bool)], [np.log10(p)], []
        # contexts seen in training are states; a gram that isn't one leads to the longest suffix that is
        fail, fail_weight = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        self.down, states = [], 1
        for m, g in enumerate(levels[:-1]):
            seen = counts[m] > 0
            shorter = self.down[-1][g.suffix] if m else np.zeros(len(seen), dtype=np.int64)
            number = np.where(seen, states + np.cumsum(seen) - 1, shorter)
            states += int(seen.sum())
            fail.append(shorter[seen])
            fail_weight.append(np.log10(k / (counts[m][seen] + k)))
            self.down.append(number)
        last = len(levels) - 1
        self.targets.append(self.down[0] if last else np.zeros(self.words, dtype=np.int64))
        for m in range(1, last + 1):
            g = levels[m]
            context = counts[m - 1][g.prefix]
            p = (counts[m] + k * p[g.suffix]) / (context + k)
            self.seen.append(counts[m] > 0)
            self.weights.append(np.log10(p))
            self.targets.append(self.down[m] if m < last else self.down[m - 1][g.suffix])
        self.fail, self.fail_weight = np.concatenate(fail).tolist(), np.concatenate(fail_weight).tolist()
        self.start = int(self.down[0][0]) if last else 0

    def arcs(self, begin: int, end: int) -> dict[int, tuple[float, int]]:
        """Weight and target of the arcs on grams that end at places from begin to before end; the key is the state times the words, and the word."""
        out: dict[int, tuple[float, int]] = {}
        for m, g in enumerate(self.levels):
            some = np.unique(g.at[begin:end])
            some = some[some >= 0]
            some = some[self.seen[m][some]]
            keys = self.down[m - 1][g.prefix[some]] * self.words + g.word[some] if m else some
            out.update(zip(keys.tolist(), zip(self.weights[m][some].tolist(), self.targets[m][some].tolist(), strict=True), strict=True))
        return out

    def scores(self, bounds: list[int], stretch: int = STRETCH) -> list[float]:
        """The log10-probability of each document, read from the start state. bounds: where documents begin, with their boundary word, and the end."""
        ids, out, arcs, until = self.levels[0].at, [], {}, 0
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            state, total, at = self.start, 0.0, begin + 1
            while at < end:
                if at >= until:
                    arcs.clear()  # before the next are made
                    until = at + stretch
                    arcs = self.arcs(at, until)
                stop = min(end, until)
                state, total = self._read(arcs, ids[at:stop].tolist(), state, total)
                at = stop
            out.append(total)
        return out

    def _read(self, arcs: dict[int, tuple[float, int]], text: list[int], state: int, total: float) -> tuple[int, float]:
        fail, fail_weight, n = self.fail, self.fail_weight, self.words
        for w in text:
            arc = arcs.get(state * n + w)
            while arc is None:
                total += fail_weight[state]
                state = fail[state]
                arc = arcs.get(state * n + w)
            total += arc[0]
            state = arc[1]
        return state, total


def _shards(made: DataFrame) -> int:
    return bl.shards_for(made, bl.BLOCK_BYTES // 8)


def score(docs: DataFrame, held_out: Column, smoothing: Smoothing = Smoothing()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns where held_out is false."""
    order = smoothing.order
    made = bl.blocks(docs.select("doc_id", "text"), lower=True, flag=held_out)
    shards = _shards(made)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                block = bl.opened(bl.columns(b), i)
                levels, first, doc = grams(block, order)
                train = ~block.flags[doc]
                for m, g in enumerate(levels):
                    used = train & (g.at >= 0)
                    if m == 0:
                        used &= ~first  # a document's beginning is no token
                    counts = np.bincount(g.key[g.at[used]], minlength=len(g.keys))
                    yield bl.requests(block.block_id, g.keys, counts, shards, _WIDTH, base=m * _ORDER)
                del block, levels, first, doc, train, g, used, counts
                bl.give_back()

    found = written(bl.answers(made.mapInArrow(ask, bl.REQUEST), _WIDTH, bl.packed_counts), "ngram-counts", batch_bytes=_BATCH_BYTES)
    sums = found.filter(F.col("shard") < _ORDER).agg(F.sum("total"), F.sum("distinct_keys")).first()
    total, distinct = (int(x or 0) for x in sums)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([_scored(bl.opened(bl.columns(left), i), right, shards, smoothing, total, distinct) for i in range(left.num_rows)])

    return made.groupBy("block_id").cogroup(found.select("block_id", "shard", "counts").groupBy("block_id")).applyInArrow(traverse, schema)


def _scored(block: bl.Block, right: pa.Table, shards: int, smoothing: Smoothing, total: int, distinct: int) -> pa.Table:
    levels, first, doc = grams(block, smoothing.order)
    counts = [bl.answered(right, m * _ORDER, np.diff(bl.shard_starts(g.keys, shards)), bits=False)[g.key] for m, g in enumerate(levels)]
    ids = levels[0].at
    tokens, n = doc[~first], len(block.lengths)
    base = np.log10((counts[0] + 0.5) / (total + 0.5 * (distinct + 1)))
    known = np.bincount(tokens, weights=counts[0][ids[~first]] > 0, minlength=n).astype(np.int64)
    base_score = np.bincount(tokens, weights=base[ids[~first]], minlength=n)
    automaton = Automaton(levels, counts, total, distinct, smoothing.k)
    bounds = np.append(np.flatnonzero(first), len(ids)).tolist()
    score_ = automaton.scores(bounds)
    return pa.table({
        "doc_id": block.doc_ids, "held_out": pa.array(block.flags), "n_tokens": pa.array(block.lengths + 1), "n_known": pa.array(known),
        "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score_, pa.float64()),
    })
