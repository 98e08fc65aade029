"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents in hashed order. A round fills one window: every source gets its quantum, its
target share of ``sequence_tokens``, on top of what it carried over, sends as many whole tokens as it has (in units of
``least_tokens`` if its quantum is smaller) and carries the rest on, across windows and partitions alike. So after k
rounds a source with quantum q has sent floor(k * q) tokens, whatever the documents, and every cut and every place in the
stream is computed from the quanta alone. Rounds follow each other in one stream that is cut every ``sequence_tokens``;
what is left at the end goes to sequences of falling powers of two, so nothing is padded.

Nulls: a null text is empty and has the end token alone; null sources form one queue, ordered last. Of more sources than
a window has tokens several share a queue, by hash. Repeated rows are packed each. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import positions
from siltstone.llm.storage import written


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    end_token: int = 1
    sequence_tokens: int = 2048
    #: A source whose quantum is smaller sends so many tokens every few rounds.
    least_tokens: int = 16
    #: Target shares by source; by default each source's share of all tokens.
    shares: dict[str | None, float] = field(default_factory=dict)


def byte_ranks(definition: str) -> dict[bytes, int] | None:
    """The byte strings and ids of a tokenizer file, if it is a byte-level one that merges in the order of its ids; else None."""
    d = json.loads(definition)
    model, before = d["model"], d["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or d["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocabulary, special = model["vocab"], {t["content"] for t in d["added_tokens"] or []}
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}


#: Longer runs of white space are left to tokenizers: the faster library's pattern would need a stack as deep as they are long.
LONG_SPACE = re.compile(r"\s{1000}")
#: So many texts of each batch are encoded both ways.
COMPARED = 4


class Encoder:
    """The ids that tokenizers gives texts by the tokenizer file, then the end token.

    A byte-level file's merges are run by tiktoken, which is four times as fast. Texts that hold a special token or a long
    run of white space go through tokenizers, and so does every text once a compared one differs.
    """

    def __init__(self, definition: str, end_token: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.end = end_token
        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.added = [t["content"] for t in json.loads(definition)["added_tokens"] or []]
        ranks = byte_ranks(definition)
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return not any(a in text for a in self.added) and not LONG_SPACE.search(text)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if self._plain(t)] if self.fast else []
        ids = dict(zip(plain, map(self.fast.encode_ordinary, [texts[i] for i in plain]), strict=True)) if plain else {}
        for i, right in zip(plain[:COMPARED], self._ids([texts[i] for i in plain[:COMPARED]]), strict=True):
            if ids[i] != right:
                self.fast, ids = None, {}
                break
        rest = [i for i in range(len(texts)) if i not in ids]
        ids.update(zip(rest, self._ids([texts[i] for i in rest]), strict=True))
        return [np.array([*ids[i], self.end], dtype="<u4") for i in range(len(texts))]


_encoders: dict[int, Encoder] = {}


def _encoder(definition: str, end_token: int) -> Encoder:
    """One per worker, kept between tasks."""
    key = xxhash.xxh64_intdigest(definition, end_token)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, end_token)
    return _encoders[key]


def encoded(docs: DataFrame, packing: Packing) -> DataFrame:
    """uid, doc_id, source, h, n, ids (two bytes each where that is enough) of every row, written once."""
    with open(packing.tokenizer, encoding="utf-8") as f:
        definition = f.read()
    wide = tokenizers.Tokenizer.from_str(definition).get_vocab_size() > 1 << 16
    sent = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer file
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.col("text").alias("_text"))
    schema = rows.drop("_text").select("*", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value, packing.end_token)
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                ids = encode([t or "" for t in b.column(4).to_pylist()])
                n = [len(x) for x in ids]
                ids = [(x if wide else x.astype("<u2")).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return written(rows.mapInArrow(run, schema), "tokens")


@dataclass(frozen=True)
class Quanta:
    """What each queue sends: quantum and unit in 2^-16 tokens and tokens, and the queue's length."""

    quantum: np.ndarray
    unit: np.ndarray
    tokens: np.ndarray

    def sent(self, rounds: np.ndarray, queue: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tokens that queues have sent after so many rounds; everything once they were given as many as they have."""
        q, u, n = self.quantum[queue], self.unit[queue], self.tokens[queue]
        given = np.minimum(rounds, -(-(n << 16) // q)) * q >> 16
        return np.where(given >= n, n, given // u * u)

    def round_of(self, token: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """The first round after which a queue has sent more than ``token`` tokens."""
        q, u, n = self.quantum[queue], self.unit[queue], self.tokens[queue]
        least = np.minimum((token // u + 1) * u, n)
        return -(-(least << 16) // q)


def packets(quanta: Quanta, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The packets of documents at places of their queues: document, start in it, length, place in the stream; by document and start."""
    first, last = quanta.round_of(at, queue), quanta.round_of(at + n - 1, queue)
    unit = quanta.unit[queue]
    # one step a round, or a unit where a round sends less
    steps = np.where(unit > 1, (at + n - 1) // unit - at // unit, last - first) + 1
    doc = np.repeat(np.arange(len(n)), steps)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)
    s = queue[doc]
    by_unit = unit[doc] > 1
    begin = np.where(by_unit, (at[doc] // unit[doc] + step) * unit[doc], 0)
    k = np.where(by_unit, quanta.round_of(np.minimum(np.maximum(begin, at[doc]), (at + n)[doc] - 1), s), first[doc] + step)
    before = quanta.sent(k - 1, s)
    begin = np.where(by_unit, begin, before)
    end = np.where(by_unit, begin + unit[doc], quanta.sent(k, s))
    begin, end = np.maximum(begin, at[doc]), np.minimum(end, (at + n)[doc])
    some = end > begin
    doc, s, k, begin, end, before = doc[some], s[some], k[some], begin[some], end[some], before[some]
    return doc, begin - at[doc], end - begin, _round_starts(quanta, k, s) + begin - before


def _round_starts(quanta: Quanta, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The place in the stream where queue s begins in round k: after all earlier rounds, and earlier queues of this one."""
    distinct, at = np.unique(k, return_inverse=True)
    by = np.argsort(at, kind="stable")
    out = np.zeros(len(k), dtype=np.int64)
    some = max(1, (1 << 20) // max(1, len(quanta.tokens)))
    ordered = at[by]
    for start in range(0, len(distinct), some):
        rounds = distinct[start : start + some, None]
        before, after = quanta.sent(rounds - 1), quanta.sent(rounds)
        places = before.sum(axis=1)[:, None] + np.cumsum(after - before, axis=1) - (after - before)
        x, y = np.searchsorted(ordered, [start, start + len(rounds)])
        rows = by[x:y]
        out[rows] = places[at[rows] - start, s[rows]]
    return out


def queued(tokens: DataFrame, packing: Packing) -> tuple[DataFrame, Quanta]:
    """``tokens`` with queue and at (the tokens before a document in its queue), and what the queues send."""
    sources = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    most = packing.sequence_tokens
    if tokens.select("source").distinct().count() > most:
        sources = tokens.groupBy((F.pmod(F.xxhash64("source"), F.lit(most))).cast("string").alias("source")).agg(F.sum("n").alias("n"))
        tokens = tokens.withColumn("source_", F.pmod(F.xxhash64("source"), F.lit(most)).cast("string"))
    else:
        tokens = tokens.withColumn("source_", F.col("source"))
    found = sources.orderBy(F.col("source").asc_nulls_last()).collect()  # at most a window's tokens
    total = sum(r["n"] for r in found)
    shares = np.array([packing.shares.get(r["source"], r["n"] / total) for r in found])
    quantum = np.maximum(1, (shares / max(1e-300, shares.sum()) * most * 65536).astype(np.int64))
    unit = np.where(quantum >= packing.least_tokens << 16, 1, packing.least_tokens)
    quanta = Quanta(quantum, unit, np.array([r["n"] for r in found], dtype=np.int64))
    numbers = tokens.sparkSession.createDataFrame([(r["source"], i) for i, r in enumerate(found)], f"_s {tokens.schema['source_'].dataType.simpleString()}, queue int")
    bits = positions.bits_for(tokens.count())
    rows = tokens.join(F.broadcast(numbers), F.col("source_").eqNullSafe(F.col("_s"))).drop("_s", "source_").withColumn("_bucket", positions.hash_bucket(F.col("h"), bits))
    return positions.running(rows, ["queue"], "_bucket", ["h", "uid"], F.col("n"), "at", buckets=len(found) << bits, nulls=False), quanta


def tail_sizes(rest: int) -> list[int]:
    """Falling powers of two that sum to ``rest``."""
    return [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pieces(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tail: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """document, start, length, sequence, offset: packets cut where sequences end; what meets again is one piece."""
    doc, start, length, place = found
    full = int(tail[0]) // size

    def sequence(p: np.ndarray) -> np.ndarray:
        return np.where(p < tail[0], p // size, full + np.searchsorted(tail, p, side="right") - 1)

    first, last = sequence(place), sequence(place + length - 1)
    parts = last - first + 1
    row = np.repeat(np.arange(len(doc)), parts)
    s = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.where(s < full, s * size, tail[np.maximum(s - full, 0)])
    ends = np.where(s < full, (s + 1) * size, tail[np.minimum(np.maximum(s - full, -1) + 1, len(tail) - 1)])
    low, high = np.maximum(place[row], begins), np.minimum((place + length)[row], ends)
    start = start[row] + low - place[row]
    doc, length, offset = doc[row], high - low, low - begins
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (start[1:] != (start + length)[:-1]) | (offset[1:] != (offset + length)[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.add.reduceat(length, at) if len(at) else length, s[at], offset[at]


def pack(docs: DataFrame, packing: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source for every piece."""
    tokens = encoded(docs, packing)
    total = tokens.agg(F.sum("n")).first()[0] or 0
    size = packing.sequence_tokens
    full = total // size
    # where the sequences after the last full one begin, and the end of the last
    tail = np.cumsum([full * size, *tail_sizes(total - full * size)])
    placed, quanta = queued(tokens, packing)
    rows = placed.select("doc_id", "source", "queue", "at", "n", "ids")
    out = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], "source").schema
    sent = docs.sparkSession.sparkContext.broadcast(quanta)  # three numbers for each of at most ``size`` queues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quanta = sent.value
        for big in batches:
            for i in range(0, big.num_rows, 1024):
                b = big.slice(i, 1024)
                queue, at, n = (b.column(k).to_numpy() for k in (2, 3, 4))
                doc, start, length, s, offset = pieces(packets(quanta, queue, at, n), tail, size)
                crc = np.zeros(len(doc), dtype=np.int64)
                edges = np.searchsorted(doc, np.arange(b.num_rows + 1))
                for d, raw in enumerate(b.column(5)):
                    raw = raw.as_py()
                    ids = memoryview(raw if len(raw) == 4 * n[d] else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes())
                    x, y = edges[d], edges[d + 1]
                    crc[x:y] = [zlib.crc32(ids[4 * p : 4 * (p + w)]) for p, w in zip(start[x:y].tolist(), length[x:y].tolist(), strict=True)]
                take = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], s, offset)), b.column(1).take(take)], names=out.names)

    return rows.mapInArrow(run, out)
