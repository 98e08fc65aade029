"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked at ``radius`` or fewer differing bits. Each of 2^(radius+1) - 1 tables keeps a fixed
set of bits: bit i is kept in table v when the parity of phi(i) & v is odd, for vectors phi(i) of radius + 1 bits. The
differing bits of a pair within the radius span too little to meet every v, so some table drops all of them and the pair
shares that table's key: no pair is missed. phi is chosen so that each table keeps about half the bits.

Equal fingerprints are one node however many rows have them. Keys that a single fingerprint has are dropped after a
count (folded before the shuffle); what is left is grouped in lists of at most ``2 * BLOCK`` fingerprints (a larger
bucket is dealt into blocks, and every pair of blocks makes a list), and each list gives a spanning forest of its links,
not its pairs. Components come from repeated star joins.

Nulls: a null text has no words and fingerprint zero; a null doc_id takes part and is never the smallest unless all of
its component are null. Repeated rows share a component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import skew
from siltstone.llm.components import components
from siltstone.llm.exact_dedup import keys, rows_at
from siltstone.llm.storage import partitions, scope, written

SEED = 42
BLOCK = 2048
_CHUNK = 1 << 15


def words(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D] after lower-casing A-Z, in UTF-8."""
    return (text or "").encode().lower().split()


def text_key(w: list[bytes]) -> int:
    """Hash of a text's words, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(w))).astype(np.int64))


def _majority(hashes: Iterator[int], n: int) -> int:
    """Bits set in over half of n hashes, as a signed long."""
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _CHUNK):
        h = np.fromiter(hashes, dtype=np.uint64, count=min(_CHUNK, n - start))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def shingle_fingerprint(text: str | None, k: int) -> int:
    """SimHash of the text's k-word shingles, repeats included; of the whole sequence if it has fewer words."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    k = min(k, len(w))
    first = np.concatenate(([0], ends[: len(w) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return _majority((digest(joined[a:b], SEED) for a, b in zip(first, ends[k - 1 :].tolist(), strict=True)), len(first))


def word_fingerprint(w: set[bytes]) -> int:
    """SimHash of a text's distinct words."""
    return _majority((xxhash.xxh64_intdigest(x, SEED) for x in w), len(w)) if w else 0


def fingerprints(docs: DataFrame, fingerprint: Callable[[str | None], int], keep: list[str]) -> DataFrame:
    """``keep`` and fp for every row."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def masks(radius: int, bits: int = 64) -> list[int]:
    """The kept bits of each table, as signed longs.

    Up to radius 5 the bits take the nonzero vectors in turn; at radius 6 they take 64 + i, a Reed-Muller code, whose
    tables keep 32 bits each (one keeps all). Beyond, vectors are drawn by hash.
    """
    n = 1 << (radius + 1)
    phi = [1 + i % (n - 1) for i in range(bits)] if n - 1 <= bits else [bits + i for i in range(bits)] if n == 2 * bits else [1 + xxhash.xxh64_intdigest(str(i)) % (n - 1) for i in range(bits)]
    out = []
    for v in range(1, n):
        mask = sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def block_pairs(member: str) -> Column:
    """The pairs of blocks that a member of a group of ``blocks`` blocks is dealt to, so that any two members meet.

    A group of one block is one pair; of more, a member's block meets every other block.
    """
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    return F.filter(others, lambda p: (F.col("blocks") == 1) | (p["i"] < p["j"]))


def buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """members: lists of fingerprints, each sharing a table's key, 2 to 2 * BLOCK long; every close pair is in one.

    nodes: fp, distinct.
    """
    tables = masks(radius)
    nodes = nodes.repartition(partitions(nodes.sparkSession))  # few bytes, but each row becomes many
    rows = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("table", "key"))
    sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("table").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    # never broadcast: it grows with the number of close pairs
    sizes = written(sizes, "bucket-sizes").hint("merge")
    shared = rows.join(sizes, (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k"))).select("table", "key", "fp", "blocks")
    dealt = shared.select("table", "key", "fp", F.explode(block_pairs("fp")).alias("pair"))
    return dealt.groupBy("table", "key", "pair").agg(F.array_sort(F.collect_list("fp")).alias("members")).select("members").distinct()


def forest(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member of its component) of the graph that links members within the radius; members ascend."""
    if len(members) == 2:
        near = int(members[0] ^ members[1]) & (2**64 - 1)
        return (members[1:], members[:1]) if near.bit_count() <= radius else (members[:0], members[:0])
    u = members.view(np.uint64)
    rest = np.arange(len(u))
    a, b = [], []
    while len(rest):
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            near = np.bitwise_count(u[rest] ^ u[todo.pop()]) <= radius
            if near.any():
                found = rest[near]
                todo += found.tolist()
                a.append(found)
                b.append(np.full(len(found), root))
                rest = rest[~near]
    if not a:
        return members[:0], members[:0]
    return members[np.concatenate(a)], members[np.concatenate(b)]


def links(lists: DataFrame, radius: int) -> DataFrame:
    """a, b: a spanning forest of the links in each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
            edges = [forest(values[x:y], radius) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            for i in range(0, len(edges), 256):
                part = edges[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in part]), pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lists.repartition(partitions(lists.sparkSession)).mapInArrow(run, "a long, b long")


def named_components(nodes: DataFrame, labels: DataFrame, name: str, least: str, out: str) -> DataFrame:
    """``name`` and ``out``, the smallest ``least`` of its component, for the nodes that have links.

    nodes: ``name``, ``least``; labels: as ``components`` gives them. A label of a third of all nodes is no hot key here.
    """
    members = written(labels.unionAll(labels.select("label", "label").distinct()), "members")
    smallest = written(members.join(nodes.withColumnRenamed(name, "node"), "node").groupBy("label").agg(F.min(least).alias(out)), "smallest")
    return skew.join(members, smallest, "label", skew.hot_keys(members, "label")).select(F.col("node").alias(name), out)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable over links) for every row."""
    with scope(docs.sparkSession):
        prints = written(fingerprints(docs.select("doc_id", "text"), lambda t: shingle_fingerprint(t, shingle), ["doc_id"]), "fingerprints", outlive=True)
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        labels = components(links(buckets(nodes.select("fp"), radius), radius))
        named = named_components(nodes, labels, "fp", "least", "component_id").withColumnRenamed("fp", "_fp")
        named = nodes.join(named, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
        named = written(named, "components", outlive=True)
        hot = skew.hot_keys(prints, "fp", outlive=True)
    return skew.join(prints, named, "fp", hot).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SET_BYTES = 8 << 20


def shingle_set(w: list[bytes], k: int) -> np.ndarray:
    """The distinct 32-bit hashes of a text's k-word shingles, ascending; of the whole sequence if it has fewer words."""
    if not w:
        return np.zeros(0, dtype=np.uint32)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    k = min(k, len(w))
    first = np.concatenate(([0], ends[: len(w) - k] + 1)).tolist()
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(first, ends[k - 1 :].tolist(), strict=True)), dtype=np.uint32, count=len(first)))


#: The most frequent shingles are looked for in so many documents.
SAMPLE = 5000
#: A shingle in such a share of the sampled documents, and in so many, is common.
COMMON_SHARE, COMMON_LEAST = 0.01, 20
#: Shingles counted in one group, on average.
GROUP_SHINGLES = 1 << 18


def prefix_length(n: int, similarity: float) -> int:
    """So many shingles, the first in an order that all sets share, hold a common one if two sets are similar."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def common_shingles(rows: DataFrame, n: int, shingle: int) -> dict[int, int]:
    """shingle: its number of documents in a sample by hash, for those that are common there.

    At most 1 / COMMON_SHARE times the mean number of shingles of a document. They are only put last in the order of
    shingles, so the sample changes how many candidates there are, never which pairs are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(words(t.as_py()), shingle).astype(np.int64))], names=["shingle"])

    every = max(1, n // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(every)) == 0).select("text")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    least = max(COMMON_LEAST, int(COMMON_SHARE * n / every))
    return {r["shingle"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}


#: Documents and shingles in a chunk at most (a longer document is a chunk of its own).
CHUNK_DOCUMENTS, CHUNK_SHINGLES = 4096, 1 << 20
_HOT, _HEAD = -1, -2


def prefix_edges(rows: DataFrame, n: int, n_words: int, shingle: int, similarity: float) -> DataFrame:
    """a, b: texts (their ``same`` hashes) that share a shingle of their prefixes, as stars; every similar pair is in a component.

    Shingles are ordered by the number of texts that have them, common ones (``common_shingles``) last, then by hash. Those
    that a single text has are first and lead to no candidate, so only texts most of whose shingles occur elsewhere do.
    Chunks of documents send their shingles' hashes to counting groups, get the counts back and pick the prefixes.
    """
    spark = rows.sparkSession
    with scope(spark):
        common = common_shingles(rows, n, shingle)
        ordered = np.array(sorted(common, key=lambda h: (common[h], h)), dtype=np.uint32)
        by_hash = np.argsort(ordered)
        sent = spark.sparkContext.broadcast((ordered, by_hash, ordered[by_hash]))  # bounded, see common_shingles
        bits = min(16, max(6, (n_words // GROUP_SHINGLES).bit_length()))
        dealt = written(rows.select("text").mapInArrow(_dealer(sent, bits, shingle, similarity), "chunk long, part int, shingles binary, of binary"), "prefix-parts")
        asked = dealt.filter("part >= 0").select("chunk", "part", "shingles")
        counts = written(asked.groupBy("part").applyInArrow(_counted, "chunk long, part int, texts binary"), "shingle-counts")
        pick = lambda left, right: _picked(left, right, similarity)
        chunks = dealt.filter(F.col("part") != _HOT).groupBy("chunk").cogroup(counts.groupBy("chunk"))
        rare = written(chunks.applyInArrow(pick, "same long, shingle long"), "prefixes")
        firsts = rare.groupBy("shingle").agg(F.min("same").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("shingle", "b")
        stars = rare.join(firsts, "shingle").select(F.col("same").alias("a"), "b")
        hot = written(dealt.filter(F.col("part") == _HOT).select("shingles", "of").mapInArrow(_unpacked, "same long, shingle long").distinct(), "common-prefixes")
        firsts = hot.groupBy("shingle").agg(F.min("same").alias("b"))
        stars = stars.unionAll(hot.join(F.broadcast(firsts), "shingle").select(F.col("same").alias("a"), "b"))
        edges = written(stars.filter("a <> b").distinct(), "prefix-stars", outlive=True)
    return edges


def _dealer(sent, bits: int, shingle: int, similarity: float) -> Callable:
    """Documents to rows of (chunk, part, shingles, of): the distinct shingles of a chunk's documents by leading bits of their
    hash, with the documents they are of; a head with the documents' texts and numbers of shingles; and for each text whose
    prefix reaches common shingles these, with the text."""
    names = ["chunk", "part", "shingles", "of"]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names)

    def chunk_rows(number: int, cold: list[np.ndarray], texts: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        yield batch([(number, _HEAD, np.array(texts, dtype=np.int64).tobytes(), np.array(sizes, dtype=np.int32).tobytes())])
        of = np.repeat(np.arange(len(cold), dtype=np.uint16), [len(x) for x in cold])
        flat = np.concatenate(cold)
        by = np.argsort(flat, kind="stable")
        flat, of = flat[by], of[by]
        ends = np.searchsorted(flat >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
        some = np.flatnonzero(np.diff(ends)).tolist()
        for i in range(0, len(some), 256):
            yield batch([(number, p, flat[ends[p] : ends[p + 1]].tobytes(), of[ends[p] : ends[p + 1]].tobytes()) for p in some[i : i + 256]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, by_hash, hashes = sent.value
        number = TaskContext.get().partitionId() << 32
        cold, texts, sizes, held = [], [], [], 0
        for b in batches:
            last = []
            for t in b.column(0):
                w = words(t.as_py())
                found = shingle_set(w, shingle)
                if not len(found):
                    continue
                same, rest = text_key(w), found
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                    hit = hashes[at] == found
                    rest = found[~hit]
                    take = prefix_length(len(found), similarity) - len(rest)
                    if take > 0:
                        last.append((number, _HOT, ordered[np.sort(by_hash[at[hit]])[:take]].tobytes(), np.array([same], dtype=np.int64).tobytes()))
                cold.append(rest)
                texts.append(same)
                sizes.append(len(found))
                held += len(rest)
                if held >= CHUNK_SHINGLES or len(cold) == CHUNK_DOCUMENTS:
                    yield from chunk_rows(number, cold, texts, sizes)
                    cold, texts, sizes, held, number = [], [], [], 0, number + 1
            if last:
                yield batch(last)
        if cold:
            yield from chunk_rows(number, cold, texts, sizes)
        pa.default_memory_pool().release_unused()

    return deal


#: More texts than this count alike.
_MOST = 255


def _counted(table: pa.Table) -> pa.Table:
    """In how many documents each shingle of a group is, for each of the rows that hold it."""
    raw = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("shingles")]
    _, at, counts = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
    found, ends = np.minimum(counts, _MOST).astype(np.uint8)[at], np.cumsum([0, *map(len, raw)])
    texts = pa.array([found[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "texts": texts})


def _picked(left: pa.Table, right: pa.Table, similarity: float) -> pa.Table:
    """The prefixes of a chunk's texts, without the shingles that no other document has."""
    part = left.column("part").to_numpy()
    get = lambda name, i, kind: np.frombuffer(left.column(name)[int(i)].as_py(), dtype=kind)
    head = int(np.flatnonzero(part == _HEAD)[0])
    texts, sizes = get("shingles", head, np.int64), get("of", head, np.int32)
    answers = {p: x for p, x in zip(right.column("part").to_pylist(), right.column("texts"), strict=True)}
    rows = np.flatnonzero(part >= 0)
    empty = [np.zeros(0, dtype=np.uint32)]
    h = np.concatenate([get("shingles", i, np.uint32) for i in rows] or empty)
    of = np.concatenate([get("of", i, np.uint16) for i in rows] or empty).astype(np.int64)
    count = np.concatenate([np.frombuffer(answers[int(part[i])].as_py(), dtype=np.uint8) for i in rows] or empty)
    # a document's shingles, those of fewest documents first
    by = np.lexsort((h, count, of))
    h, of, count = h[by], of[by], count[by]
    own = np.bincount(of, minlength=len(texts))
    place = np.arange(len(h)) - np.repeat(np.cumsum(own) - own, own)
    lengths = np.array([prefix_length(int(k), similarity) for k in sizes], dtype=np.int64)
    chosen = (place < lengths[of]) & (count > 1)
    return pa.table({"same": pa.array(texts[of[chosen]], pa.int64()), "shingle": pa.array(h[chosen].astype(np.int64), pa.int64())})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, same in zip(b.column(0), b.column(1), strict=True):
            h = np.frombuffer(h.as_py(), dtype=np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), np.frombuffer(same.as_py(), dtype=np.int64)[0])), pa.array(h)], names=["same", "shingle"])


def jaccard_forest(keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member of its component) of the graph that links sets of at least this Jaccard similarity."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=bool)
    a, b = [], []
    rest = np.arange(len(sets))
    while len(rest):
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            i = todo.pop()
            like = rest[(sizes[rest] >= similarity * sizes[i]) & (sizes[i] >= similarity * sizes[rest])]
            if not len(like):
                continue
            own = codes[starts[i] : starts[i + 1]]
            seen[own] = True
            lengths = sizes[like]
            at = np.repeat(starts[like] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            common = np.bincount(np.repeat(np.arange(len(like)), lengths), weights=seen[codes[at]], minlength=len(like))
            seen[own] = False
            near = common >= similarity * (sizes[i] + lengths - common) - 1e-9
            found = like[near]
            if len(found):
                todo += found.tolist()
                a.append(found)
                b.append(np.full(len(found), root))
                rest = np.setdiff1d(rest, found, assume_unique=True)
    if not a:
        return keys[:0], keys[:0]
    return keys[np.concatenate(a)], keys[np.concatenate(b)]


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` with one document (smallest doc_id) of each group of near copies, all columns.

    Documents are linked when their sets of ``shingle``-word shingles are as similar as ``similarity`` (Jaccard). Candidates
    are components over two kinds of links: fingerprints of the distinct words within ``radius`` bits, found by covering,
    and, as no radius holds all similar pairs, prefixes of the shingle sets (``prefix_edges``), which miss none. Within a
    candidate component the shingle sets themselves are compared.
    Documents without words are one group. Nulls in doc_id are larger than any other. Of rows with one doc_id and the same
    words the first by file and row stays.
    """
    names = docs.columns
    docs, rows = keys(docs, names, "doc_id", "text")
    with scope(docs.sparkSession):
        kept = written(_kept(rows, shingle, similarity, radius), "kept", outlive=True)
    return rows_at(docs, names, kept, "left_semi")


def _kept(rows: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """_file, _row of the rows that stay."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.zeros((b.num_rows, 3), dtype=np.int64)
            for i, t in enumerate(b.column(3)):
                w = words(t.as_py())
                found[i] = text_key(w), word_fingerprint(set(w)), len(w)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(found[:, i]) for i in range(3)]], names=["doc_id", "_file", "_row", "same", "fp", "words"])
        pa.default_memory_pool().release_unused()

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.select("doc_id", "_file", "_row", "text").mapInArrow(sign, f"doc_id {kind}, _file string, _row long, same long, fp long, words long"), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_file", "_row")
    nodes = written(signed.groupBy("same").agg(F.min(order).alias("first"), F.min("fp").alias("fp")), "nodes")
    total = signed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()

    edges = star_edges(nodes, radius).unionAll(prefix_edges(rows, total["n"], total["words"], shingle, similarity))
    joined = components(edges)
    joined = joined.unionAll(joined.select("label", "label").distinct()).withColumnRenamed("node", "same")
    candidates = written(nodes.join(joined, "same").select("label", "same", "first._file", "first._row"), "candidates")
    near = components(similar(rows, candidates, shingle, similarity))
    grouped = nodes.select("same", "first").join(near.withColumnRenamed("node", "same"), "same", "left").select("first", F.coalesce("label", "same").alias("group"))
    return grouped.groupBy("group").agg(F.min("first").alias("stays")).select("stays._file", "stays._row")


def star_edges(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: stars over the texts (``same``) whose fingerprints are linked within ``radius``, directly or over others."""
    with scope(nodes.sparkSession):
        labels = components(links(buckets(nodes.select("fp").distinct(), radius), radius))
        # equal fingerprints are one node of the covering search
        labelled = written(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("same", F.coalesce("label", "fp").alias("label")), "labelled")
        centres = written(labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("b")).filter("n > 1").select("label", "b"), "centres")
        edges = written(skew.join(labelled, centres, "label", skew.hot_keys(labelled, "label")).select(F.col("same").alias("a"), "b"), "stars", outlive=True)
    return edges


def similar(rows: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: a spanning forest of the similar pairs within each candidate component."""

    def collect_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(words(t.as_py()), shingle).tobytes() for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], names=["label", "same", "shingles"])
        pa.default_memory_pool().release_unused()

    def link(table: pa.Table) -> pa.Table:
        same = table.column("same").to_numpy()
        by = np.argsort(same)
        raw = table.column("shingles")
        a, b = jaccard_forest(same[by], [np.frombuffer(raw[int(i)].as_py(), dtype=np.uint32) for i in by], similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # never broadcast: candidates grow with the documents
    texts = rows.select("_file", "_row", "text").join(candidates.hint("merge"), ["_file", "_row"]).select("label", "same", "text")
    sets = written(texts.mapInArrow(collect_sets, "label long, same long, shingles binary"), "shingles")
    blocks = F.ceil(F.sum(F.octet_length("shingles") + 64) / SET_BYTES)
    sizes = written(sets.groupBy("label").agg(blocks.alias("blocks")), "set-sizes")
    dealt = skew.join(sets, sizes, "label", skew.hot_keys(sets, "label")).select("label", "same", "shingles", F.explode(block_pairs("same")).alias("pair"))
    return dealt.select("label", "pair.i", "pair.j", "same", "shingles").groupBy("label", "i", "j").applyInArrow(link, "a long, b long")
