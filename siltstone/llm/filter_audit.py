"""What each filter of a chain removes, in every order of the chain.

A document's failures are one mask, a bit for each filter. Documents are folded into cells, one for each part and mask
(parts times 2^filters rows at most), before anything else; the cells are unpivoted against the steps of every order. A
running bit-or over the steps before says whether an earlier filter has removed a cell; conditional sums of the cells give
a step's metrics, and totals over a filter's steps of all orders its Shapley sum (times the number of orders).

The last filter, copies, compares texts by SHA-256: a document fails if an equal text has a smaller doc_id anywhere in the
table. Rows are folded by (digest, part, mask, labels) with their smallest doc_id, so a text that a third of all rows
share is a few rows after each task's partial sums, and no row is joined back.

Nulls: a null text is empty, a null part the empty string; a null doc_id is neither smaller nor larger than any other and
has no label. Repeated rows, and rows of one doc_id and text, don't fail as copies of each other. A document is good (or
toxic) if any row of its labels says so. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.exact_dedup import sha256

#: Rows without a doc_id are dealt to so many keys of the join with labels.
_NULL_KEYS = 1024


@dataclass(frozen=True)
class Limits:
    least_words: int = 100
    least_distinct: int = 80
    """Distinct words in a hundred."""
    most_capitals: int = 10
    """Capitals A-Z in a hundred code points."""
    symbols: str = "[#$%&*|]"


def text_filters(text: Column, limits: Limits) -> dict[str, Column]:
    """Failure conditions of a text that isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < limits.least_words,
        "B": F.size(F.array_distinct(words)) * 100 < n * limits.least_distinct,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * limits.most_capitals,
        "D": text.rlike(limits.symbols),
    }


def masked(docs: DataFrame, part: str, limits: Limits) -> DataFrame:
    """doc_id, part, digest, mask: the failures of each text, bits in the order of the filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = F.lit(0)
    for i, failed in enumerate(text_filters(F.col("text"), limits).values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return rows.select("doc_id", "part", sha256(F.col("text")).alias("digest"), mask.cast("int").alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, copies: int) -> DataFrame:
    """part, mask, n, good, toxic: documents with each mask. copies: the bit of the filter for copies."""
    folded = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = lambda c: F.max(F.col(c) == 1).alias(c)
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")).withColumn("_k", F.lit(0))
    # a row without doc_id never matches; its key only spreads such rows
    keyed = folded.withColumn("_k", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_NULL_KEYS))).otherwise(0).cast("int"))
    known = keyed.join(said, ["doc_id", "_k"], "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])

    has_id = F.col("doc_id").isNotNull()
    same = known.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    at_first = F.coalesce(F.when(F.col("least.doc_id") == first, F.col("least.n")), F.lit(0))
    split = same.withColumn("passed", F.col("without") + at_first).select(
        "part", "quality", "toxic", F.inline(F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    )
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("quality"), count("toxic"))


def steps(masks: DataFrame, filters: str) -> DataFrame:
    """The metrics of every step of every order of ``filters`` (one letter each, bits in that order) over ``cells``."""
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    unpivoted = masks.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("_i", "filter"))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), F.col("filter"))
    unpivoted = unpivoted.withColumn("step", F.col("_i") + 1).withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    judged = unpivoted.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0
    total = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)
    out = judged.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "quality", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return out.drop("filter")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return steps(cells(masked(docs, part, limits), labels, copies=1 << 4), "ABCDE")
