"""Deltas between the wanted and the remote state, receipts, and the canonical manifest with generation fencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.latest import first_by

#: Total order of local records, newest first; nulls first as production orders them.
NEWEST = ("succeeded_at", "review_id", "line", "part", "supplier")


def latest_local(local: DataFrame) -> DataFrame:
    """The newest succeeded record of each item, removals included."""
    return first_by(local.filter("succeeded"), ["item_id"], [F.desc_nulls_first(NEWEST[0]), *[F.desc(c) for c in NEWEST[1:]]])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def same_path(code: Column, previous: Column) -> Column:
    return F.concat(F.lit("images/"), code, F.lit("/"), basename(previous))


def deltas(wanted: DataFrame, local: DataFrame) -> DataFrame:
    """item_id, action, target, previous for every item whose remote copy differs from what is wanted.

    wanted: item_id, code, desired, review_id. local: item_id, action, local_code, review_id, original_changed, suffix.
    """
    old = local.select("item_id", F.col("action").alias("last_action"), "local_code", F.col("review_id").alias("local_review"), "original_changed", "suffix")
    rows = wanted.join(old, "item_id", "full")
    item, code = F.col("item_id").cast("string"), F.col("code")
    present = F.coalesce(F.col("last_action") != "REMOVE", F.lit(False))
    desired = F.coalesce(F.col("desired"), F.lit(False))
    suffix = F.coalesce(F.col("suffix"), F.lit(".image"))
    previous = F.concat(F.lit("images/"), F.col("local_code"), F.lit("/"), item, suffix)
    fresh = F.concat(F.lit("images/"), code, F.lit("/"), item, suffix)
    kept = same_path(code, previous)
    moved = (previous != kept) & (F.col("local_code") != code)
    restated = (previous != kept) | ~F.col("review_id").eqNullSafe(F.col("local_review"))
    action = (
        F.when(desired & ~present, "ADD").when(desired & F.col("original_changed"), "ADD").when(desired & moved, "MOVE").when(desired & restated, "ADD").when(~desired & present, "REMOVE")
    )
    target = F.when(action == "REMOVE", F.concat(F.lit("_removed/"), item, suffix)).when(~present | F.col("original_changed"), fresh).otherwise(kept)
    before = F.when(action.isin("MOVE", "REMOVE") | (present & F.col("original_changed")), previous)
    return rows.select("item_id", action.alias("action"), target.alias("target"), before.alias("previous")).filter("action IS NOT NULL")


def pending_counts(pending: DataFrame, delta: DataFrame, categories: DataFrame) -> DataFrame:
    """code, n for every active category: scheduled pending items plus deltas that are not scheduled yet. All have code."""
    unscheduled = delta.join(pending.select("item_id"), "item_id", "left_anti")
    both = pending.select("code").unionAll(unscheduled.select("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return categories.filter("active").select("code").join(both, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def receipt_problems(stored: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """problem, n: reasons to reject a payload as a whole."""
    k = [F.col(c) for c in keys]
    repeated = payload.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    unknown = payload.join(stored, keys, "left_anti")
    joined = payload.join(stored.select(*keys, F.col("status").alias("_status"), F.col("sha256").alias("_sha")), keys)
    changed = joined.filter("_status = 'SUCCEEDED' AND status = 'SUCCEEDED' AND sha256 <> _sha")
    undone = joined.filter("_status = 'SUCCEEDED' AND status = 'FAILED'")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    return count(repeated, "REPEATED").unionAll(count(unknown, "UNKNOWN")).unionAll(count(changed, "CHANGED_SUCCESS")).unionAll(count(undone, "FAILED_AFTER_SUCCESS"))


def apply_receipt(stored: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the payload applied: a first success sets hash and status, a failure a constant code; successes stay."""
    p = payload.select(*keys, F.col("status").alias("_status"), F.col("sha256").alias("_sha"))
    done = F.col("status") == "SUCCEEDED"
    now = F.coalesce(F.col("_status") == "SUCCEEDED", F.lit(False))
    failed = F.coalesce(F.col("_status") == "FAILED", F.lit(False))
    return stored.join(p, keys, "left").select(
        *[c for c in stored.columns if c not in ("status", "sha256", "error")], F.when(done | now, "SUCCEEDED").otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("sha256")).when(now, F.col("_sha")).alias("sha256"), F.when(~done & ~now, F.when(failed, F.lit("SYNC_FAILED")).otherwise(F.col("error"))).alias("error"),
    )


def canonical_merge(canonical: DataFrame, operations: DataFrame, facts: list[str]) -> DataFrame:
    """item_id, version, ``facts``, outcome: the manifest after one operation an item, with what became of the operation.

    Older generations are SKIPPED; an equal one must say the same, else CONFLICT (a removal always); newer ones remove or
    replace the row. Rows with outcome REMOVED are no longer in the manifest.
    """
    ops = operations.select("item_id", F.col("version").alias("_v"), F.col("action").alias("_a"), *[F.col(c).alias(f"_{c}") for c in facts])
    rows = canonical.withColumn("_known", F.lit(True)).join(ops, "item_id", "full")
    known, has_op = F.coalesce("_known", F.lit(False)), F.col("_v").isNotNull()
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    removes = F.col("_a") == "REMOVE"
    outcome = (
        F.when(~has_op, "UNCHANGED").when(known & (F.col("_v") < F.col("version")), "SKIPPED")
        .when(known & (F.col("_v") == F.col("version")), F.when(~removes & same, "REPEATED").otherwise("CONFLICT"))
        .when(removes, "REMOVED").when(known, "REPLACED").otherwise("ADDED")
    )
    takes = outcome.isin("REPLACED", "ADDED", "REMOVED")
    return rows.select("item_id", F.when(takes, F.col("_v")).otherwise(F.col("version")).alias("version"), *[F.when(takes, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in facts], outcome.alias("outcome"))


def fence(operations: DataFrame, records: DataFrame) -> DataFrame:
    """operations with accepted: not older than the newest record of the item, nor equal to it with another action."""
    newest = records.groupBy("item_id").agg(F.max(F.struct("version", "action")).alias("_n"))
    v = F.col("_n.version")
    joined = operations.join(newest, "item_id", "left")
    return joined.withColumn("accepted", v.isNull() | (F.col("version") > v) | ((F.col("version") == v) & (F.col("action") == F.col("_n.action")))).drop("_n")


def epoch(items: DataFrame, *versions: tuple[DataFrame, str, str]) -> DataFrame:
    """item_id, generation: one more than the greatest of the versions that any of the tables (frame, key, version) has for the item."""
    all_versions = None
    for df, key, version in versions:
        part = df.select(F.col(key).alias("item_id"), F.col(version).cast("long").alias("v"))
        all_versions = part if all_versions is None else all_versions.unionAll(part)
    most = all_versions.groupBy("item_id").agg(F.max("v").alias("v"))
    return items.select("item_id").join(most, "item_id", "left").select("item_id", (F.coalesce("v", F.lit(0)) + 1).alias("generation"))


def failure_locks(attempts: DataFrame, gap: str, failures: int = 5, period: str = "5 MINUTES") -> DataFrame:
    """key, ts, streak, locked, locked_until for every failure: streaks restart after a success or a gap; from the
    ``failures``-th on each failure locks for ``period``.

    attempts: key, ts, seq (a tie-break), failure, success.
    """
    by = Window.partitionBy("key").orderBy("ts", "seq")
    rows = attempts.filter("failure OR success").withColumn("_last", F.lag("ts").over(by)).withColumn("_cleared", F.lag("success").over(by))
    fresh = F.col("_last").isNull() | F.col("_cleared") | (F.col("ts") - F.col("_last") >= F.expr(f"INTERVAL {gap}"))
    rows = rows.withColumn("_streak", F.sum(fresh.cast("int")).over(by))
    streak = F.sum(F.col("failure").cast("long")).over(Window.partitionBy("key", "_streak").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    locked = F.col("streak") >= failures
    until = F.when(locked, F.col("ts") + F.expr(f"INTERVAL {period}"))
    return rows.withColumn("streak", streak).filter("failure").select("key", "ts", "seq", "streak", locked.alias("locked"), until.alias("locked_until"))
