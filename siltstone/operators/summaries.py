"""Nested summaries, pages with totals, counts by kind, open items passed on, and snapshots filled in later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import progress


def item_summaries(item: DataFrame, category: DataFrame, current: DataFrame) -> DataFrame:
    """Every item with its category and its current review as structs; the latter is null without one."""
    c = category.select("category_id", F.struct("category_id", "code", "name", "active").alias("category"))
    r = current.select("item_id", F.struct("review_id", "member", "decision", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).alias("review"))
    return item.join(F.broadcast(c), "category_id").join(r, "item_id", "left").select("item_id", "source", "record_id", "active", "category", "review")


def snapshot(columns: Sequence[str], days: Sequence[str] = ()) -> Column:
    """Columns as JSON for an audit trail, nulls included; ``days`` and times as ISO text."""
    shown = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in days else F.col(c) for c in columns]
    return F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with the number of all rows beside each. The count is a pass of its own, folded in each task: no window over all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return progress.page(df, order, limit, offset).join(F.broadcast(total), F.lit(True))


def kind_counts(df: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """kind, n for every known kind, zero where there is none, with the total in a row of its own (TOTAL)."""
    counted = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    rows = every.join(counted, kind, "full").select(kind, F.coalesce("n", F.lit(0)).alias("n"))
    return rows.unionAll(counted.agg(F.lit("TOTAL").alias(kind), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def split_counts(df: DataFrame, split: str, by: str, values: Sequence[str]) -> DataFrame:
    """split, a column for each value of ``by`` and total, as a pivot with known values."""
    rows = df.groupBy(split).pivot(by, list(values)).agg(F.count(F.lit(1)))
    rows = rows.select(split, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])
    return rows.join(df.groupBy(split).agg(F.count(F.lit(1)).alias("total")), split)


def ordered_union(*lists: DataFrame) -> DataFrame:
    """place, host of lists (position, host), lower-case, first come first: a host keeps its first place."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select(F.lit(i).alias("_list"), "position", F.lower(F.trim("host")).alias("host"))
        rows = part if rows is None else rows.unionAll(part)
    first = rows.groupBy("host").agg(F.min(F.struct("_list", "position")).alias("_at"))
    # allowlists: as many rows as hosts were ever approved
    return first.select(F.row_number().over(Window.orderBy("_at", "host")).alias("place"), "host")


def pass_on(state: DataFrame, requests: DataFrame, reviewed: DataFrame, members: DataFrame) -> DataFrame:
    """item_id, open_member, version, outcome of requests to release an open item (null member) or to hand it to another.

    state: item_id, version, active, open_member. requests, one an item: item_id, version, member. reviewed: item_id,
    member, current, of all reviews. members: member, active. Who takes an item may have nothing open and may not have
    reviewed it; of two requests for one member the first by item wins. A handed item must be active, a released one need not.
    """
    asked = requests.select("item_id", F.col("version").alias("_expected"), F.col("member").alias("_to"))
    rows = asked.join(state, "item_id", "left")
    done = reviewed.filter("current").select("item_id").distinct().withColumn("_done", F.lit(True))
    knows = reviewed.select("item_id", F.col("member").alias("_to")).distinct().withColumn("_knows", F.lit(True))
    busy = state.filter("open_member IS NOT NULL").select(F.col("open_member").alias("_to")).distinct().withColumn("_busy", F.lit(True))
    able = members.filter("active").select(F.col("member").alias("_to")).distinct().withColumn("_able", F.lit(True))
    rows = rows.join(done, "item_id", "left").join(knows, ["item_id", "_to"], "left").join(busy, "_to", "left").join(able, "_to", "left")
    hands = F.col("_to").isNotNull()
    outcome = (
        F.when(F.col("version").isNull(), "NOT_FOUND").when(F.col("version") != F.col("_expected"), "STALE_CANDIDATE_VERSION").when(F.col("open_member").isNull(), "CANDIDATE_NOT_OPEN")
        .when(hands & ~F.col("active"), "SPECIES_NOT_ACTIVE").when(F.col("_done"), "CANDIDATE_ALREADY_REVIEWED")
        .when(hands & (F.col("_able").isNull() | F.col("_busy").isNotNull() | F.col("_knows").isNotNull()), "REVIEWER_NOT_ELIGIBLE")
    )
    rows = rows.withColumn("_problem", outcome)
    # the first of the requests that pass takes the member: a minimum by member, folded before the shuffle
    first = rows.filter(hands & F.col("_problem").isNull()).groupBy("_to").agg(F.min("item_id").alias("_first"))
    rows = rows.join(first, "_to", "left")
    late = hands & F.col("_problem").isNull() & (F.col("_first") != F.col("item_id"))
    outcome = F.when(late, "REVIEWER_NOT_ELIGIBLE").when(F.col("_problem").isNotNull(), F.col("_problem")).when(hands, "TRANSFERRED").otherwise("RELEASED")
    went = F.col("outcome").isin("TRANSFERRED", "RELEASED")
    return rows.withColumn("outcome", outcome).select("item_id", F.when(went, F.col("_to")).otherwise(F.col("open_member")).alias("open_member"), (F.col("version") + went.cast("int")).alias("version"), "outcome")


def filled(rows: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with null columns taken from ``source`` (one row a key): snapshots that older rows lack."""
    given = source.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return rows.join(given, key, "left").select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])
