"""Review progress and administrative lists: star joins to small dimensions, semi and anti joins, zero-filled counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import trimmed

DECISIONS = ("APPROVED", "REJECTED", "UNSURE")


def active_items(item: DataFrame, category: DataFrame) -> DataFrame:
    return item.filter("active").join(category.filter("active").select("category_id"), "category_id")


def overview(item: DataFrame, category: DataFrame, current: DataFrame) -> DataFrame:
    """total, reviewed, open, pending, reviewed share and the same as a percentage of two places, ties to even, of the active items, in one pass over items."""
    reviewed = F.col("_reviewed").isNotNull()
    rows = active_items(item, category).join(current.select("item_id", F.lit(1).alias("_reviewed")), "item_id", "left")
    counted = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(reviewed).alias("reviewed"), F.count_if(~reviewed & F.col("open_member").isNotNull()).alias("open"))
    share = F.when(F.col("total") > 0, F.col("reviewed") / F.col("total")).otherwise(0.0)
    return counted.withColumns({"pending": F.greatest(F.lit(0), F.col("total") - F.col("reviewed") - F.col("open")), "share": share, "percent": F.bround(share * 100, 2)})


def decisions(item: DataFrame, category: DataFrame, current: DataFrame) -> DataFrame:
    """decision, n: current decisions on active items, every decision listed."""
    counted = current.join(active_items(item, category).select("item_id"), "item_id", "left_semi").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counted, "decision", DECISIONS, ["n"])


def zero_filled(counted: DataFrame, key: str, values: Sequence, counts: Sequence[str]) -> DataFrame:
    """``counted`` with a row for each value of a small fixed dimension."""
    dimension = counted.sparkSession.createDataFrame([(v,) for v in values], f"{key} {counted.schema[key].dataType.simpleString()}")
    return dimension.join(counted, key, "left").select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])


def members(review: DataFrame, n_members: int, day: str) -> DataFrame:
    """Per member: attempts, attempts by decision, attempts on one UTC day (half-open)."""
    start = F.lit(day).cast("timestamp_ntz")
    today = (F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY"))
    counts = [F.count(F.lit(1)).alias("attempts"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in DECISIONS], F.count_if(today).alias("today")]
    counted = review.groupBy("member").agg(*counts)
    return zero_filled(counted, "member", range(n_members), ["attempts", *[d.lower() for d in DECISIONS], "today"])


def eligible(item: DataFrame, category: DataFrame, current: DataFrame) -> DataFrame:
    """Active items that nobody has open or reviewed."""
    return active_items(item, category).filter(F.col("open_member").isNull()).join(current, "item_id", "left_anti")


def any_contains(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive substring of any column; % and _ in ``text`` are wildcards, as LIKE has them."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def conditions(**given) -> Column:
    """The conjunction of the filters that are given: column=value, nothing for None."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in given.items() if v is not None], F.lit(True))


def between_days(column: str, first: str | None, last: str | None) -> Column:
    """Half-open range of days; the last day is included."""
    out = F.lit(True)
    if first:
        out = out & (F.col(column) >= F.lit(first).cast("timestamp_ntz"))
    if last:
        out = out & (F.col(column) < F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return out


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order, 1 to 100 rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows from offset 0 on")
    return df.orderBy(*order).offset(offset).limit(limit)


def history(review: DataFrame, item: DataFrame, category: DataFrame) -> DataFrame:
    """review x item x category; the dimension side is small and broadcast by size."""
    return review.join(item.select("item_id", "category_id", "source", "record_id", F.col("active").alias("item_active")), "item_id").join(category.select("category_id", "code", "name"), "category_id")


def category_counts(item: DataFrame, category: DataFrame) -> DataFrame:
    """Every category with its number of items and a map of items by source, sources ascending."""
    by_source = item.groupBy("category_id", "source").agg(F.count(F.lit(1)).alias("n"))
    counted = by_source.groupBy("category_id").agg(F.sum("n").alias("n_items"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("_by"))
    joined = category.join(counted, "category_id", "left")
    return joined.select("category_id", "code", "active", "sort_order", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce(F.map_from_entries("_by"), F.expr("map()").cast("map<string,bigint>")).alias("by_source"))


def source_catalog(item: DataFrame, most: int = 1000) -> DataFrame:
    """Distinct sources in case-insensitive order; one more than ``most`` tells that there are too many."""
    return item.select("source").distinct().orderBy(F.lower("source"), "source").limit(most + 1)


def facts(decision: Column, reason: Column) -> Column:
    """whole and exact facts of a decision, as a struct."""
    pair = lambda a, b: F.struct(F.lit(a).alias("whole"), F.lit(b).alias("exact"))
    return (
        F.when(decision == "APPROVED", pair("YES", "YES"))
        .when((decision == "REJECTED") & (reason == "WRONG_SPECIES"), pair("REVIEW", "NO"))
        .when((decision == "REJECTED") & (reason == "NOT_WHOLE_FISH"), pair("NO", "REVIEW"))
        .when((decision == "REJECTED") & (reason == "NOT_A_FISH"), pair("NO", "NO"))
        .otherwise(pair("REVIEW", "REVIEW"))
    )


def decision_notes(notes: Column) -> Column:
    """Notes as they are kept: trimmed, null if nothing is left."""
    return F.nullif(trimmed(notes), F.lit(""))


def decision_problem(decision: Column, reason: Column, notes: Column) -> Column:
    """What is wrong with a decision payload, or null: a reason iff rejected, notes with OTHER."""
    blank = decision_notes(notes).isNull()
    return (
        F.when(~decision.isin(*DECISIONS), "UNKNOWN_DECISION")
        .when((decision == "REJECTED") & reason.isNull(), "REASON_REQUIRED")
        .when((decision != "REJECTED") & reason.isNotNull(), "REASON_NOT_ALLOWED")
        .when((reason == "OTHER") & blank, "NOTES_REQUIRED")
    )
