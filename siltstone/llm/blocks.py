"""Blocks of tokenised documents, and global counts of the keys that they ask for.

A block is one row with some megabytes of text as word numbers into its own vocabulary. To learn how often its keys
(hashes of words, n-grams or windows) occur in the whole corpus, a block sends each distinct key once, with its own
count, to the key's shard; a shard adds the counts up and answers in the order asked. A key that holds a third of all
rows is still one entry a block, and a shard holds an even share of all distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import partitions, written

BLOCK_BYTES = 6 << 20
#: Distinct keys, counted once a block, in a shard at most, on average.
SHARD_KEYS = 4_000_000
#: Keys that a shard adds up at a time, on average.
SLICE_KEYS = 1 << 18
#: Sums are answered up to this.
MOST = 2**32 - 1

REQUEST = "shard int, block_id long, keys binary, counts binary"
ANSWER = "block_id long, shard int, counts binary, total long, distinct_keys long"


class Vocabulary(dict):
    """Numbers words in the order they are first looked up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Block:
    block_id: int
    doc_ids: pa.Array
    flags: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    words: list[bytes]

    @property
    def starts(self) -> np.ndarray:
        """Where each document begins in ``ids``, and the end."""
        return np.concatenate(([0], np.cumsum(self.lengths)))

    def word_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))


def blocks(docs: DataFrame, *, lower: bool, flag=None) -> DataFrame:
    """Blocks of ``docs``, written once; ``flag`` is a boolean column kept for each document."""
    rows = docs.select("doc_id", (F.lit(False) if flag is None else flag).alias("flag"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block_id long, doc_ids array<{kind}>, flags binary, lengths binary, ids binary, vocabulary binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def row(doc_ids: list[pa.Array], flags: list[bool], lengths: list[int], ids: list[np.ndarray], words: Vocabulary) -> pa.RecordBatch:
            together = pa.concat_arrays(doc_ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together)
            values = [pa.array([number], pa.int64()), listed, *(pa.array([x], pa.binary()) for x in (np.array(flags, dtype=np.uint8).tobytes(), np.array(lengths, dtype=np.int64).tobytes(), np.concatenate(ids).tobytes(), b" ".join(words)))]
            return pa.RecordBatch.from_arrays(values, names=["block_id", "doc_ids", "flags", "lengths", "ids", "vocabulary"])

        new = lambda: ([], [], [], [], Vocabulary())
        held, size = new(), 0
        for b in batches:
            for i, (flag_, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                raw = (text.as_py() or "").encode()
                w = (raw.lower() if lower else raw).split()
                held[0].append(b.column(0).slice(i, 1))
                held[1].append(bool(flag_))
                held[2].append(len(w))
                held[3].append(np.fromiter(map(held[4].__getitem__, w), dtype=np.uint32, count=len(w)))
                size += len(raw) + 64
                if size >= BLOCK_BYTES:
                    yield row(*held)
                    held, size, number = new(), 0, number + 1
        if held[0]:
            yield row(*held)

    return written(rows.mapInArrow(run, schema), "blocks")


def opened(row: dict[str, pa.Array], i: int = 0) -> Block:
    """The block in row i of a batch or table given by its columns."""
    get = lambda name: row[name][i].as_py()
    vocabulary = get("vocabulary")
    doc_ids = row["doc_ids"]
    doc_ids = (doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids)[i].values
    return Block(get("block_id"), doc_ids, np.frombuffer(get("flags"), dtype=np.uint8).astype(bool), np.frombuffer(get("lengths"), dtype=np.int64), np.frombuffer(get("ids"), dtype=np.uint32), vocabulary.split(b" ") if vocabulary else [])


def give_back() -> None:
    """Returns memory that this worker has freed, as it waits beside tasks of other stages that need none of it."""
    pa.system_memory_pool().release_unused()


def columns(batch: pa.RecordBatch | pa.Table) -> dict:
    return {name: batch.column(name) for name in batch.schema.names}


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two arrays of 64-bit hashes, in their order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + ((b << np.uint64(29)) | (b >> np.uint64(35))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def shards_for(blocks_: DataFrame, keys_a_block: int) -> int:
    """How many shards keep each to an even share of SHARD_KEYS keys at most."""
    return max(partitions(blocks_.sparkSession), -(-blocks_.count() * keys_a_block // SHARD_KEYS))


def shard_starts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin among ascending keys: a shard owns an even range of hashes."""
    edges = np.array([(i << 64) // shards for i in range(shards)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def requests(block_id: int, keys: np.ndarray, counts: np.ndarray, shards: int, width: int, base: int = 0) -> pa.RecordBatch:
    """Rows of REQUEST for ascending distinct keys; of each key its lowest ``width`` bytes are sent, its shard says more."""
    at = shard_starts(keys, shards)
    cut = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    counts = counts.astype("<u4")
    some = [s for s in range(shards) if at[s] < at[s + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([base + s for s in some], pa.int32()), pa.array([block_id] * len(some), pa.int64()), pa.array([cut[at[s] : at[s + 1]].tobytes() for s in some], pa.binary()), pa.array([counts[at[s] : at[s + 1]].tobytes() for s in some], pa.binary())],
        names=["shard", "block_id", "keys", "counts"],
    )


def _content(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column one after the other, not copied."""
    column = column.cast(pa.binary())
    _, offsets, content = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(content, dtype=np.uint8)[ends[0] : ends[-1]] if content else np.zeros(0, dtype=np.uint8)


def _keys(content: np.ndarray, width: int) -> np.ndarray:
    if width == 8:
        return content.view("<u8")
    keys = np.zeros((len(content) // width, 8), dtype=np.uint8)
    keys[:, :width] = content.reshape(-1, width)
    return keys.view("<u8").ravel()


def answers(asked: DataFrame, width: int, pack: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Rows of ANSWER: for each request the sums over all blocks, up to MOST, written by ``pack``; total and distinct_keys of the shard in one row of it.

    A shard adds its keys up a slice at a time, so beside what it is sent and answers it holds two or three words a key of a slice.
    """

    def add(table: pa.Table) -> pa.Table:
        batches = table.select(["keys", "counts"]).to_batches()
        keys = [_keys(_content(b.column(0)), width) for b in batches]
        counts = [_content(b.column(1)).view("<u4") for b in batches]
        slices = -(-sum(map(len, keys)) // SLICE_KEYS)
        owner = [(k % np.uint64(max(slices, 1))).astype(np.uint16) for k in keys]
        found, total, distinct_keys = [np.empty(len(k), dtype=np.uint32) for k in keys], 0, 0
        for s in range(slices):
            at = [np.flatnonzero(x == s) for x in owner]
            distinct, inverse = np.unique(np.concatenate([k[i] for k, i in zip(keys, at, strict=True)]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([c[i] for c, i in zip(counts, at, strict=True)]), minlength=len(distinct)).astype(np.int64)
            total, distinct_keys = total + int(sums.sum()), distinct_keys + int((sums > 0).sum())
            said = np.minimum(sums, MOST).astype(np.uint32)[inverse]
            for f, i, part in zip(found, at, np.split(said, np.cumsum([len(i) for i in at])[:-1]), strict=True):
                f[i] = part
        del keys, counts, owner
        packed = []
        for b, f in zip(batches, found, strict=True):
            ends = np.cumsum([len(x.as_buffer()) // 4 for x in b.column(1)]).tolist()
            packed.append(pa.array([pack(f[i:j]) for i, j in zip([0, *ends], ends, strict=False)], pa.binary()))
        del found, batches
        give_back()
        first = lambda x: pa.array([x] + [0] * (table.num_rows - 1), pa.int64())
        return pa.table({"block_id": table.column("block_id"), "shard": table.column("shard"), "counts": pa.chunked_array(packed, pa.binary()), "total": first(total), "distinct_keys": first(distinct_keys)})

    return asked.groupBy("shard").applyInArrow(add, ANSWER)


def packed_counts(sums: np.ndarray) -> bytes:
    return sums.astype("<u4").tobytes()


def packed_repeats(sums: np.ndarray) -> bytes:
    """One bit a key: whether its sum is over 1."""
    return np.packbits(sums > 1).tobytes()


def answered(table: pa.Table, base: int, sizes: np.ndarray, bits: bool) -> np.ndarray:
    """The answers for a block's keys, in their order. sizes: keys of each shard."""
    by = {s: x for s, x in zip(table.column("shard").to_pylist(), table.column("counts"), strict=True)}
    parts = []
    for s in np.flatnonzero(sizes):
        raw = by[base + int(s)].as_py()
        parts.append(np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=int(sizes[s])).astype(bool) if bits else np.frombuffer(raw, dtype="<u4").astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=bool if bits else np.int64)
