"""State transitions as new state = f(old state, batch of commands): joins and windows, written to a new place by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.latest import first_by


def assign_next(eligible: DataFrame, idle: DataFrame) -> DataFrame:
    """member, item_id: each idle member gets the next eligible item, both in order of their ids.

    Only as many items as there are members can be assigned, so the order of items is cut there before it is numbered.
    """
    n = idle.count()
    items = eligible.orderBy("item_id").limit(n).withColumn("_n", F.row_number().over(Window.orderBy("item_id")))
    members = idle.withColumn("_n", F.row_number().over(Window.orderBy("member")))
    return members.join(items.select("item_id", "_n"), "_n").select("member", "item_id")


def first_responses(commands: DataFrame) -> DataFrame:
    """commands with outcome: the first of each (member, command_key) is APPLIED, equal ones are REPEATED, others CONFLICT."""
    w = Window.partitionBy("member", "command_key").orderBy("seq")
    first = F.first("digest").over(w)
    return commands.withColumn("outcome", F.when(F.row_number().over(w) == 1, "APPLIED").when(F.col("digest") == first, "REPEATED").otherwise("CONFLICT"))


def decide(commands: DataFrame, items: DataFrame) -> DataFrame:
    """commands with outcome: only the member who has the item open may decide, once.

    commands: member, command_key, digest, seq, item_id. items: item_id, open_member.
    """
    answered = first_responses(commands)
    holds = answered.join(items.select("item_id", "open_member"), "item_id", "left")
    mine = F.col("open_member").eqNullSafe(F.col("member"))
    turn = F.row_number().over(Window.partitionBy("item_id", "_ok").orderBy("seq"))
    holds = holds.withColumn("_ok", (F.col("outcome") == "APPLIED") & mine).withColumn("_turn", turn)
    outcome = F.when(F.col("outcome") != "APPLIED", F.col("outcome")).when(~F.col("_ok"), "NOT_ASSIGNED").when(F.col("_turn") > 1, "ALREADY_DECIDED").otherwise("APPLIED")
    return holds.withColumn("outcome", outcome).drop("_ok", "_turn", "open_member")


def edit(state: DataFrame, edits: DataFrame, facts: list[str]) -> DataFrame:
    """state after optimistic edits (key, expected, facts): version + 1 where expected is the version, else conflict stays."""
    e = edits.select(F.col("key").alias("_key"), "expected", *[F.col(c).alias(f"_{c}") for c in facts])
    rows = state.join(e, F.col("key") == F.col("_key"), "left")
    hit = F.col("expected") == F.col("version")
    outcome = F.when(F.col("_key").isNull(), "UNCHANGED").when(hit, "EDITED").otherwise("CONFLICT")
    return rows.select("key", (F.col("version") + hit.cast("int")).alias("_v"), *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in facts], outcome.alias("outcome"), F.col("version").alias("_old")).select("key", F.coalesce("_v", "_old").alias("version"), *facts, "outcome")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the columns that ``changes`` gives (null: keep); version + 1 only where something differs."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = rows.join(c, F.col(key) == F.col("_key"), "left")
    differs = F.lit(False)
    for x in columns:
        differs = differs | (F.col(f"_{x}").isNotNull() & ~F.col(f"_{x}").eqNullSafe(F.col(x)))
    return joined.select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x in columns else (F.col(x) + differs.cast("int")).alias(x) if x == "version" else F.col(x) for x in rows.columns], differs.alias("changed"))


def reopen_targets(reviews: DataFrame, requests: DataFrame, items: DataFrame) -> DataFrame:
    """requests (item_id, member) with allowed: the member never reviewed the item and has nothing open."""
    reviewed = reviews.select("item_id", "member").distinct().withColumn("_r", F.lit(1))
    busy = items.filter("open_member IS NOT NULL").select(F.col("open_member").alias("member")).distinct().withColumn("_b", F.lit(1))
    return requests.join(reviewed, ["item_id", "member"], "left").join(busy, "member", "left").select("item_id", "member", (F.col("_r").isNull() & F.col("_b").isNull()).alias("allowed"))


def bulk_disable(items: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """items with the chosen ones inactive and released, and matched, disabled, released counts of before."""
    summary = items.filter(which).agg(F.count(F.lit(1)).alias("matched"), F.count_if("active").alias("disabled"), F.count_if(F.col("open_member").isNotNull()).alias("released"))
    chosen = F.coalesce(which, F.lit(False))
    kept = [c for c in items.columns if c not in ("active", "open_member")]
    return items.select(*kept, (F.col("active") & ~chosen).alias("active"), F.when(~chosen, F.col("open_member")).alias("open_member")), summary


def toggle_category(items: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """item_id, version: the versions of all items of a category go up when its ``active`` changes."""
    changed = before.select("category_id", F.col("active").alias("_a")).join(after.select("category_id", F.col("active").alias("_b")), "category_id").filter("_a <> _b").select("category_id", F.lit(1).alias("_up"))
    return items.join(changed, "category_id", "left").select("item_id", (F.col("version") + F.coalesce("_up", F.lit(0))).alias("version"))


def record(index: DataFrame, results: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """results with outcome: ADDED for a new key, REPEATED if the index holds equal facts (nulls included), else CONFLICT."""
    old = index.select(*keys, *[F.col(c).alias(f"_{c}") for c in facts], F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = F.when(F.col("_known").isNull(), "ADDED").when(same, "REPEATED").otherwise("CONFLICT")
    return results.join(old, keys, "left").select(*keys, *facts, outcome.alias("outcome"))


def clear_matching(intents: DataFrame, expected: DataFrame) -> DataFrame:
    """intents without those that equal an expected row in every column, nulls included."""
    e = expected.select(*[F.col(c).alias(f"_{c}") for c in intents.columns])
    same = F.lit(True)
    for c in intents.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return intents.join(e, same, "left_anti")


def mark_submitted(index: DataFrame, submitted: DataFrame, keys: list[str]) -> DataFrame:
    """index with submitted_at set the first time only."""
    now = submitted.select(*keys, F.col("submitted_at").alias("_now"))
    return index.join(now, keys, "left").select(*[c for c in index.columns if c != "submitted_at"], F.coalesce("submitted_at", "_now").alias("submitted_at"))


def inconsistent(latest: DataFrame, canonical: DataFrame, facts: list[str]) -> DataFrame:
    """item_id of latest records that the canonical manifest doesn't show as they are: absent after REMOVE, else equal."""
    c = canonical.select("item_id", *[F.col(x).alias(f"_{x}") for x in facts], F.lit(True).alias("_there"))
    same = F.coalesce("_there", F.lit(False))
    for x in facts:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return latest.join(c, "item_id", "left").filter(F.when(F.col("action") == "REMOVE", F.col("_there").isNotNull()).otherwise(~same)).select("item_id")


def effective_status(batches: DataFrame, now: Column) -> DataFrame:
    """batches with status ``expired`` where a pending one's time is over."""
    over = (F.col("status") == "pending") & (F.col("expires_at") <= now)
    return batches.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def oldest_pending(batches: DataFrame, scope: str) -> DataFrame:
    """The oldest pending batch of each scope."""
    return first_by(batches.filter("status = 'pending'"), [scope], [F.col("created_at"), F.col("batch_id")])
