"""How far the sources of a language are apart in their words, by joint histograms of counts.

Tasks fold whole texts into counts per language, source and term. Terms that a language keeps get one row for each block
of its sources, with the sources that hold the term and their counts. For each pair of sources the distinct combinations
(count, count) of those rows are tallied, and combinations with a zero follow from the sources' own histograms: of the
terms that one of them holds, those that both hold are taken away, and what no one holds is the rest of the vocabulary. The
divergence is then evaluated once for each combination, times its number of terms, in both directions.

With p and q as shares in billionths (1 + floor(10^9 (count + 1) / (N + V)), so none is zero), a term adds
floor((p - q)^2 / q). All arithmetic is in integers; the sum of a pair is below 10^18 + 10^9 V.

Nulls: a null text, language or source is the empty string. Repeated rows count as rows. A language without kept terms has
pairs of value 0; a language of one source has no pair. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.storage import scope, written

#: Lower-cases A-Z and makes every ASCII byte that is no letter a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a task holds before it sends them.
HELD = 400_000
#: Sources in a block, on average: a term's row has at most two blocks of them.
BLOCK = 256
#: Combinations that a task holds before it folds them; terms in a batch of the tally.
TALLY = 1 << 20
#: Groups of language and source whose figures are broadcast.
BROADCAST_GROUPS = 100_000
_SALTS = 256
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Limits:
    least_documents: int = 3
    """Documents of its language that a kept term is in."""
    most_terms: int = 200
    """Ranks of terms listed for each group."""


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it); each group has a row with a null term too."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                size = len(n) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size), pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs_.__getitem__, n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )

        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                w = text.as_py().encode().translate(_LETTERS).split()
                size -= len(n)
                n.update(w)
                seen.update(set(w))
                size += len(n)
                if size >= HELD:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    told = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows as the small side of a join: broadcast if that is bounded, else never."""
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df.hint("merge")


def joint(terms: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), x, y (their counts, none zero), n (terms). terms: lang, one, held: rows of sources and counts.

    ``one``: whether the row is a block paired with itself; else only pairs of different blocks are tallied.
    """

    def fold(parts: list[np.ndarray]) -> list[np.ndarray]:
        """Columns a, b, x, y, n."""
        table = np.concatenate(parts, axis=1)
        order = np.lexsort(table[3::-1])
        table = table[:, order]
        new = np.ones(table.shape[1], dtype=bool)
        new[1:] = (table[:4, 1:] != table[:4, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        return [np.vstack([table[:4, at], np.add.reduceat(table[4], at)])] if len(at) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        held: list[np.ndarray] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for table in fold(held) if held else []:
                a, b = ([names[i] for i in table[k].tolist()] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), *(pa.array(table[k]) for k in (2, 3, 4))], names=["lang", "a", "b", "x", "y", "n"]
                )

        for batch in batches:
            lists = batch.column("held")
            inside = lists.flatten()
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lengths)), lengths)
            langs, sources = batch.column("lang").to_pylist(), inside.field("source").to_pylist()
            key = np.empty(len(row), dtype=np.int64)
            for i, (r, s) in enumerate(zip(row.tolist(), sources, strict=True)):
                k = (langs[r], s)
                if k not in numbers:
                    numbers[k] = len(names)
                    names.append(k)
                key[i] = numbers[k]
            count, block = inside.field("n").to_numpy(), inside.field("block").to_numpy()
            one = np.asarray(batch.column("one").to_pylist(), dtype=bool)[row]
            # long rows first, so that each offset d looks at a prefix only
            order = np.lexsort((row, -lengths[row]))
            row, key, count, block, one, left = row[order], key[order], count[order], block[order], one[order], lengths[row][order]
            for d in range(1, int(lengths.max(initial=0))):
                end = int(np.searchsorted(-left, -d))  # rows of more than d entries
                i = np.flatnonzero(row[: max(0, end - d)] == row[d:end])
                i = i[one[i] | (block[i] != block[i + d])]
                # sources ascend in a row
                held.append(np.vstack([key[i], key[i + d], count[i], count[i + d], np.ones(len(i), dtype=np.int64)]))
                size += len(i)
                if size >= TALLY:
                    held = fold(held)
                    if (size := sum(t.shape[1] for t in held)) >= TALLY // 2:
                        yield from sent()
                        held, size = [], 0
        yield from sent()

    told = terms.select("lang", "one", "held").mapInArrow(run, "lang string, a string, b string, x long, y long, n long")
    return told.groupBy("lang", "a", "b", "x", "y").agg(F.sum("n").alias("n"))


def share(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (size + terms)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (size + terms).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(counts: DataFrame, least_documents: int) -> DataFrame:
    """lang, term, source, n, total (in the language), first (once a term), of kept terms. A window holds a row for each source."""
    same = Window.partitionBy("lang", "term")
    entries = counts.filter("term IS NOT NULL").select(
        "lang", "term", "source", "n", F.sum("n").over(same).alias("total"), F.sum("docs").over(same).alias("docs"), F.row_number().over(same.orderBy("source")).alias("place")
    )
    return entries.filter(F.col("docs") >= least_documents).select("lang", "term", "source", "n", "total", (F.col("place") == 1).alias("first"))


def figures(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, size, terms, lang_size, sources of every group; windows hold a row for each source of a language."""
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("firsts"))
    by = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = groups.join(own, ["lang", "source"], "left")
    return joined.select("lang", "source", zero(F.col("size")).alias("size"), zero(F.sum("firsts").over(by)).alias("terms"), zero(F.sum("size").over(by)).alias("lang_size"), F.count(F.lit(1)).over(by).alias("sources"))


def source_rows(entries: DataFrame, known: DataFrame, n_groups: int) -> DataFrame:
    """lang, one, held: for each term and pair of blocks of its language's sources the counts in them."""
    blocks = known.select("lang", F.ceil(F.col("sources") / BLOCK).alias("blocks")).distinct()
    dealt = entries.join(few(blocks, n_groups), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("lang", "term", "source", "n", "block", other.alias("_o")).withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o"))
    rows = dealt.groupBy("lang", "term", "i", "j").agg(F.collect_list(F.struct("source", "block", "n")).alias("held"))
    return rows.filter(F.size("held") > 1).select("lang", (F.col("i") == F.col("j")).alias("one"), F.array_sort("held").alias("held"))


def pair_values(entries: DataFrame, known: DataFrame, n_groups: int) -> DataFrame:
    """lang, source, item, value for each two sources of a language."""
    both = written(joint(source_rows(entries, known, n_groups)), "joint")
    zero = F.lit(0).cast("long")
    # what one of a pair's sources holds, less what both hold, is what the other has none of
    alone = entries.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    others = few(known.select("lang", F.col("source").alias("other")), n_groups)
    alone = alone.join(others, "lang").filter("source <> other")
    first = F.col("source") < F.col("other")
    alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.when(first, F.col("n")).otherwise(zero).alias("x"), F.when(first, zero).otherwise(F.col("n")).alias("y"), F.col("m").alias("n"))
    split = both.select("lang", "a", "b", F.inline(F.array(F.struct("x", "y", "n"), F.struct(F.col("x"), zero.alias("y"), (-F.col("n")).alias("n")), F.struct(zero.alias("x"), F.col("y"), (-F.col("n")).alias("n")))))
    cells = split.unionByName(alone).groupBy("lang", "a", "b", "x", "y").agg(F.sum("n").alias("n")).filter("n > 0")

    side = lambda c: few(known.select("lang", F.col("source").alias(c), F.col("size").alias(f"size_{c}"), "terms"), n_groups)
    p, q = (share(F.col(n), F.col(f"size_{c}"), F.col("terms")) for n, c in (("x", "a"), ("y", "b")))
    shares = cells.join(side("a"), ["lang", "a"]).join(side("b").drop("terms"), ["lang", "b"]).select("lang", "a", "b", "n", p.alias("p"), q.alias("q"))
    times = lambda f, name: F.sum(F.col("n") * f).alias(name)
    sums = shares.groupBy("lang", "a", "b").agg(F.sum("n").alias("held"), times(divergence(F.col("p"), F.col("q")), "ab"), times(divergence(F.col("q"), F.col("p")), "ba"))

    pairs = side("a").join(few(known.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b")), n_groups), "lang").filter("a < b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left")
    # combinations with two zeros: the rest of the vocabulary
    rest = F.col("terms") - F.coalesce("held", zero)
    p, q = (F.when(rest > 0, share(zero, F.col(f"size_{c}"), F.col("terms"))) for c in ("a", "b"))
    total = lambda c, f: F.coalesce(c, zero) + F.coalesce(rest * f, zero)
    pairs = pairs.select("lang", "a", "b", total(F.col("ab"), divergence(p, q)).alias("ab"), total(F.col("ba"), divergence(q, p)).alias("ba"))
    return pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))))


def term_values(entries: DataFrame, known: DataFrame, n_groups: int, most: int) -> DataFrame:
    """lang, source, item, value, rank of the terms that a source uses more than its language does, most diverging first."""
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("lang_size"), F.col("terms"))
    over = entries.join(few(known, n_groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    # a group may hold a third of all terms: the best of each part of it first
    parts = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(_SALTS))).orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= most).drop("rank")
    return best.withColumn("rank", F.row_number().over(_ranked())).filter(F.col("rank") <= most)


def _ranked():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with scope(docs.sparkSession):
        counts = written(term_counts(docs), "term-counts")
        entries = written(kept_counts(counts, limits.least_documents), "kept-counts")
        groups = counts.filter("term IS NULL").select("lang", "source")
        known = written(figures(groups, entries), "figures")
        n_groups = known.count()
        pairs = pair_values(entries, known, n_groups).withColumn("rank", F.row_number().over(_ranked()))
        out = pairs.withColumn("part", F.lit("pair")).unionByName(term_values(entries, known, n_groups, limits.most_terms).withColumn("part", F.lit("term")))
        return written(out.select("lang", "source", "part", "item", "value", "rank"), "divergence", outlive=True)
