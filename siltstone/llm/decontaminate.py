"""Benchmark passages in documents, by a generalised suffix automaton of the benchmark's items.

Items are cut into pieces that overlap by a window less a word, and pieces are dealt into shards of bounded size. Each
shard becomes one suffix automaton over words, built by the workers that need it. A document streams through it word by
word: the state holds the longest run of words that ends here and lies in an item. A run of a window or more is a hit with
all its words; an item shorter than a window is one when it is a suffix of the run. More shards are more passes over the
documents; later passes write only the documents that they hit, so memory is bounded by a shard and nothing is left out.

Nulls: a null text has no words; a null item_id hits words but isn't counted as an item. Repeated rows are judged each by
itself; repeated items count once by item_id. An empty benchmark hits nothing; an empty table gives an empty result. Extra
columns are ignored by ``hits`` and kept by ``decontaminate``, whatever they are called.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.exact_dedup import keys
from siltstone.llm.storage import scope, unused, written

#: Lower-cases A-Z and makes every ASCII byte that is no letter or digit a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")
#: Words of items in one automaton, on average; an automaton has at most twice as many states.
SHARD_WORDS = 1 << 18
#: Words in a piece of an item.
PIECE_WORDS = 1 << 14

SPANS = "array<struct<first:bigint,words:bigint,start:bigint,end:bigint>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Automaton:
    """All runs of words of some pieces. ``moves``: state -> word -> state; state 0 is the empty run."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.moves: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, w in pieces:
            last = 0
            for x in w:
                last = self._extend(last, x)
        #: Items with a window that ends in a state, and shorter items by the states of their whole sequences.
        self.items: dict[int, set[str | None]] = defaultdict(set)
        self.short: dict[int, dict[int, set[str | None]]] = defaultdict(lambda: defaultdict(set))
        for item, w in pieces:
            for state, n in self._runs(w):
                if n == window:
                    self.items[state].add(item)
                elif n == len(w):
                    self.short[state][n].add(item)
        self.items, self.short = dict(self.items), {k: dict(v) for k, v in self.short.items()}
        # a state's nearest suffix (or itself) that holds a short item; a link's length is less than its state's
        self.nearest = [-1] * len(self.link)
        if self.short:
            for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.nearest[s] = s if s in self.short else self.nearest[self.link[s]]

    def _add(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, x: bytes) -> int:
        moves, link, length = self.moves, self.link, self.length
        if (q := moves[last].get(x)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, x)
        new = self._add(length[last] + 1, 0, {})
        p = last
        while p >= 0 and x not in moves[p]:
            moves[p][x] = new
            p = link[p]
        if p >= 0:
            q = moves[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, x)
        return new

    def _clone(self, p: int, q: int, x: bytes) -> int:
        """The shorter runs of state q, up to p's runs and x, as a state of their own."""
        own = self._add(self.length[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = own
        while p >= 0 and self.moves[p].get(x) == q:
            self.moves[p][x] = own
            p = self.link[p]
        return own

    def _cut(self, state: int, n: int) -> int:
        """The state of the last n words of a run of n words or more that is in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _runs(self, w: list[bytes]) -> Iterator[tuple[int, int]]:
        """State and length of the last words, a window's at most, at each place of a piece."""
        state = 0
        for i, x in enumerate(w):
            state = self.moves[state][x]
            n = min(i + 1, self.window)
            if n == self.window:
                state = self._cut(state, n)
            yield state, n

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans (first word, end) covered by occurrences, ascending, and the items that occur."""
        moves, link, length, nearest, window = self.moves, self.link, self.length, self.nearest, self.window
        found: list[tuple[int, int]] = []
        items: set[str | None] = set()
        state = n = 0
        short = bool(self.short)
        for i, x in enumerate(w):
            if (to := moves[state].get(x)) is not None:
                state, n = to, n + 1
            elif state:
                while state and x not in moves[state]:
                    state = link[state]
                n = length[state]
                if (to := moves[state].get(x)) is not None:
                    state, n = to, n + 1
            if n >= window:
                items |= self.items[self._cut(state, window)]
                found.append((i + 1 - n, i + 1))
            if short and (s := nearest[state]) > 0:
                while s > 0:
                    for size, whose in self.short[s].items():
                        if size <= n:
                            items |= whose
                            found.append((i + 1 - size, i + 1))
                    s = nearest[link[s]]
        return union(found), items - {None}


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (string), n (words), piece: the items' normalised words, in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIECE_WORDS - window + 1)
        for b in batches:
            ids, said = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words(text.as_py())
                for at in range(0, max(1, len(w) - window + 1), step) if w else ():
                    ids.append(item)
                    said.append(w[at : at + step + window - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(map(len, said), pa.int64()), pa.array([b" ".join(x) for x in said], pa.binary())], names=["item_id", "n", "piece"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, n long, piece binary")


_built: dict[str, Automaton] = {}


def _automaton(name: str, rows: Callable[[], list[tuple[str | None, bytes]]], window: int) -> Automaton:
    """Of the shard called so; a worker holds one shard's at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton([(item, piece.split(b" ")) for item, piece in rows()], window)
    return _built[name]


def _pass(rows: DataFrame, keep: list[str], shard: list[tuple[str | None, bytes]], window: int, hit_only: bool) -> DataFrame:
    """``keep``, n_words, spans, items of ``rows`` by one shard of pieces. The text is the column after ``keep``."""
    schema = rows.select(*[f"`{c}`" for c in keep], F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema
    name = uuid.uuid4().hex
    sent = rows.sparkSession.sparkContext.broadcast(shard)  # SHARD_WORDS words
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "words", "start", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, lambda: sent.value, window)
        for b in batches:
            at, n_words, spans, items = [], [], [], []
            for i, text in enumerate(b.column(len(keep))):
                raw = (text.as_py() or "").encode().translate(_NORMAL)
                w = raw.split()
                found, which = automaton.search(w)
                if hit_only and not found:
                    continue
                at.append(i)
                n_words.append(len(w))
                spans.append(placed(text.as_py(), raw, found) if found else [])
                items.append(sorted(which))
            kept = [b.column(k).take(pa.array(at, pa.int64())) if hit_only else b.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])

    return rows.mapInArrow(run, schema)


def placed(text: str, raw: bytes, found: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans of words with their places in the text, in code points."""
    edges = [m.span() for m in _WORD.finditer(raw)]
    whole, out, at, chars = text.encode(), [], 0, 0
    for a, b in found:
        start, end = edges[a][0], edges[b - 1][1]
        chars += len(whole[at:start].decode())
        begin, chars = chars, chars + len(whole[start:end].decode())
        at = end
        out.append({"first": a, "words": b - a, "start": begin, "end": chars})
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, spans (first word, words, start, end in code points; disjoint, ascending), items of every row."""
    with scope(docs.sparkSession):
        cut = written(pieces(benchmark, window), "pieces")
        shards = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS))
        dealt = cut.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)))
        shard = lambda k: [(r["item_id"], bytes(r["piece"])) for r in dealt.filter(F.col("shard") == k).collect()]  # noqa: E731  a shard, not the whole
        name = unused("_text", list(keep))
        if shards == 1:
            return _pass(docs.select(*keep, F.col("text").alias(name)), list(keep), shard(0), window, hit_only=False)
        docs, rows = keys(docs, docs.columns, *keep, "text")
        rows = rows.select(*[f"`{c}`" for c in keep], "_file", "_row", F.col("text").alias(name))
        base = written(_pass(rows, [*keep, "_file", "_row"], shard(0), window, hit_only=False), "first-hits", outlive=True)
        later = [written(_pass(rows.select("_file", "_row", name), ["_file", "_row"], shard(k), window, hit_only=True), "hits") for k in range(1, shards)]
        more = later[0]
        for other in later[1:]:
            more = more.unionAll(other)
        more = more.groupBy("_file", "_row").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        more = written(more, "more-hits", outlive=True)
    both = base.join(more, ["_file", "_row"], "left")
    together = F.array_sort(F.concat("spans", F.coalesce("_spans", F.array().cast(SPANS))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    return both.select(*[f"`{c}`" for c in keep], "n_words", _merged(together).alias("spans"), items.alias("items"))


def _merged(spans: Column) -> Column:
    """Ascending spans, overlapping and touching ones as one."""
    end = lambda x: x["first"] + x["words"]

    def add(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.struct(last["first"].alias("first"), (F.greatest(end(last), end(x)) - last["first"]).alias("words"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) == 0) | (x["first"] > end(F.try_element_at(out, F.lit(-1)))), F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer)))

    return F.aggregate(spans, F.array().cast(SPANS), add)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, longest: int = 0, most_coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans of more than ``longest`` words; rows go whose words are hit in more than ``most_coverage``."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" if n != "text" else "text" for i, n in enumerate(names)])
    found = hits(own, benchmark, window, tuple(own.columns)).filter(hit_words(F.col("spans")) <= F.col("n_words") * F.lit(float(most_coverage)))
    cut = F.filter("spans", lambda x: x["words"] > longest)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda x: x["end"]))
    ends = F.concat(F.transform(cut, lambda x: x["start"]), F.array(F.length("text").cast("long")))
    rest = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substr("text", (a + 1).cast("int"), (b - a).cast("int"))), "")
    text = F.when(F.size(cut) > 0, rest).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c == "text" else c for c in own.columns]).toDF(*names)
