"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms (lower-cased words) over all documents give the lexicon: the terms whose inverse
document frequency lies in a band. A text's fingerprint has one hash of its sorted distinct lexicon terms for the whole
lexicon and one for each randomised subset of it; subsets keep from half the terms to one in 512, so that nearly equal
texts agree almost everywhere and half-equal ones on some sparse subsets. Likeness is the share of agreeing hashes among
those where either text has terms.

The band is given by document frequency as a share of the documents. As every document has so many distinct terms on
average (D), there are at most D / ``least`` terms in it, whatever the number of documents: the lexicon can be broadcast,
and its size is checked.

Texts without lexicon terms take all their distinct terms. Nulls: a null text is empty; a null doc_id is ordered last.
Rows with one doc_id are ordered by text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import blocks as bl
from siltstone.llm.storage import partitions, written

CHUNK_BYTES = 6 << 20
CACHE = 400_000


@dataclass(frozen=True)
class Lexicon:
    """Document frequency band, and how many subsets keep one in ``rates`` terms each."""

    least: float = 0.0005
    most: float = 0.2
    rates: tuple[int, ...] = (2, 8, 32, 128, 512)
    subsets: int = 8
    #: Terms that may be broadcast; the band's width bounds them, this checks it.
    most_terms: int = 4_000_000


def terms(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


def lexicon(docs: DataFrame, shape: Lexicon) -> np.ndarray:
    """The ascending hashes of the terms in the band."""
    n = docs.count()
    shards = max(partitions(docs.sparkSession), -(-n // 20_000))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = bl.Vocabulary(), 0
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, seen), dtype=np.uint64, count=len(seen))
            order = np.argsort(h)
            frequency = np.bincount(np.concatenate(counts), minlength=len(seen))
            return bl.requests(0, h[order], frequency[order], shards, 8)

        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                found = terms(text)
                counts.append(np.fromiter(map(seen.__getitem__, found), dtype=np.int64, count=len(found)))
                size += len(text)
                if size > CHUNK_BYTES:
                    yield flush()
                    seen, size, counts = bl.Vocabulary(), 0, []
        if seen:
            yield flush()

    def band(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), dtype="<u8") for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("counts")])
        distinct, inverse = np.unique(keys, return_inverse=True)
        df = np.bincount(inverse, weights=counts)
        inside = distinct[(df >= shape.least * n) & (df <= shape.most * n)]
        return pa.table({"n": pa.array([len(inside)], pa.int64()), "keys": pa.array([inside.tobytes()], pa.binary())})

    found = written(docs.select("text").mapInArrow(ask, bl.REQUEST).groupBy("shard").applyInArrow(band, "n long, keys binary"), "lexicon")
    size = found.agg(F.sum("n")).first()[0] or 0
    if size > shape.most_terms:
        raise ValueError(f"{size} terms in the band; narrow it")
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.keys, dtype="<u8") for r in found.select("keys").toLocalIterator())]))


class Fingerprinter(dict):
    """Fingerprints texts against a lexicon; remembers the lexicon's number of each word, -1 for others."""

    def __init__(self, hashes: np.ndarray, shape: Lexicon) -> None:
        super().__init__()
        self.hashes, self.shape = hashes, shape
        self.kept = self.subsets(hashes)

    def subsets(self, hashes: np.ndarray) -> np.ndarray:
        """Row 0 the whole lexicon, then each subset: whether it keeps each term."""
        rows = [np.ones(len(hashes), dtype=bool)]
        for i, rate in enumerate(r for r in self.shape.rates for _ in range(self.shape.subsets)):
            rows.append(bl.mix(hashes, np.full(1, i + 1, dtype=np.uint64)) % np.uint64(rate) == 0)
        return np.array(rows)

    def __missing__(self, word: bytes) -> int:
        h = np.uint64(xxhash.xxh64_intdigest(word))
        i = int(np.searchsorted(self.hashes, h))
        self[word] = i = i if i < len(self.hashes) and self.hashes[i] == h else -1
        return i

    def __call__(self, text: str) -> np.ndarray:
        """One 32-bit hash for each subset, 0 where it has none of the text's terms."""
        words = terms(text)
        numbers = set(map(self.__getitem__, words))
        numbers.discard(-1)
        if len(self) > CACHE:
            self.clear()
        if numbers:
            at = np.fromiter(numbers, dtype=np.int64, count=len(numbers))
            at.sort()
            hashes, kept = self.hashes[at], self.kept[:, at]
        else:
            hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
            kept = self.subsets(hashes)
        digest = xxhash.xxh32_intdigest
        return np.array([digest(hashes[k].tobytes()) or 1 if k.any() else 0 for k in kept], dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    return float((a == b)[either].mean()) if either.any() else 1.0


def written_as(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


_prints: dict[int, Fingerprinter] = {}


def _fingerprinter(sent, shape: Lexicon) -> Fingerprinter:
    """One per worker and lexicon, kept between tasks."""
    hashes = sent.value
    key = xxhash.xxh64_intdigest(hashes.tobytes())
    if key not in _prints:
        _prints.clear()
        _prints[key] = Fingerprinter(hashes, shape)
    return _prints[key]


def in_order(docs: DataFrame, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, bucket, tail: the documents in buckets of rising doc_id; the next bucket's first comes along as a tail."""
    size, least = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    n = max(partitions(docs.sparkSession), -(-int(size or 0) // bucket_bytes))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    cuts = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if least is not None else []
    bounds = np.array(sorted({int(least), *map(int, cuts)}) if least is not None else [0], dtype=np.int64)

    @F.pandas_udf("int")
    def code(doc_id: pd.Series) -> pd.Series:
        """Twice the bucket, plus 1 for its first document."""
        null = doc_id.isna().to_numpy()
        x = doc_id.fillna(0).to_numpy().astype(np.int64)
        at = np.where(null, len(bounds) - 1, np.searchsorted(bounds, x, side="right") - 1)
        return pd.Series((2 * at + ((bounds[at] == x) & ~null)).astype(np.int32))

    rows = docs.select("doc_id", "text", code("doc_id").alias("_code"))
    bucket, last = F.shiftright("_code", 1), len(bounds) - 1
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("tail"))
    before = F.struct(F.when(bucket == 0, last).otherwise(bucket - 1).alias("bucket"), F.lit(True).alias("tail"))
    return rows.select("doc_id", "text", F.inline(F.when(F.col("_code") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))


def fingerprint_edits(docs: DataFrame, shape: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, shape))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(table: pa.Table) -> pa.Table:
        prints = _fingerprinter(sent, shape)
        table = table.set_column(table.schema.get_field_index("text"), "text", pc.fill_null(table.column("text"), ""))
        order = [("doc_id", "ascending"), ("text", "ascending")]
        sort = lambda t: t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_end"))
        own, tail = (sort(table.filter(pc.equal(table.column("tail"), x))) for x in (False, True))
        texts = pa.concat_arrays([c for t in (own.select(["text"]), tail.slice(0, 1).select(["text"])) for c in t.column(0).chunks] or [pa.array([], pa.string())])
        rows = []
        # the tail; without one (no doc_id has a number), the first document again
        following = texts[len(texts) - 1 if tail.num_rows else 0].as_py()
        following_print = prints(following)
        # from the last to the first, each text meets the one after it
        for i in range(own.num_rows - 1, -1, -1):
            text = texts[i].as_py()
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            own_print, edited_print = prints(text), prints(edited)
            rows.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), written_as(own_print), written_as(edited_print), likeness(own_print, edited_print), likeness(own_print, following_print)))
            following, following_print = text, own_print
        rows.reverse()
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table({"doc_id": own.column("doc_id")} | {name: pa.array([r[k] for r in rows], kinds[k]) for k, name in enumerate(names)})

    return in_order(docs).groupBy("bucket").applyInArrow(run, out)
