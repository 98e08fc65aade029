"""Export batches: deltas with all they depend on, batches made of them, and what a receipt leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators import counts, latest, sync

#: What one batch may hold.
MOST_ROWS, MOST_BYTES = 10_000, 20 * 1024 * 1024
LIVE_FOR = "7 DAYS"
_SUFFIX = r"(\.[^./]+)$"


def scoped_deltas(wanted: DataFrame, local: DataFrame, batch: str, scope: str | None = None) -> DataFrame:
    """item_id, review_id, code, action, target, previous of every item whose remote copy differs from what is wanted.

    wanted, one row an item: item_id, code, desired, review_id (current), latest_review_id, version, metadata (fingerprint),
    original, suffix. local, its newest succeeded record: item_id, action, local_code, review_id, version, metadata,
    original, path. A changed original is fetched anew; else the copy keeps its name and moves with its code. A delta needs
    a review: the current one, for removals else the latest or the one the copy was made with. With a scope (a code) only
    items that have it now or had it at the copy.
    """
    old = local.select("item_id", F.col("action").alias("_last"), "local_code", F.col("review_id").alias("_review"), F.col("version").alias("_version"), F.col("metadata").alias("_metadata"), F.col("original").alias("_original"), "path")
    rows = wanted.join(old, "item_id", "left")
    c = F.col
    present = F.coalesce(c("_last") != "REMOVE", F.lit(False))
    new_original = ~c("_original").eqNullSafe(c("original"))
    fresh = F.concat(F.lit("images/"), c("code"), F.lit("/"), c("item_id").cast("string"), c("suffix"))
    kept = F.when(new_original, fresh).otherwise(sync.same_path(c("code"), c("path")))
    elsewhere = (c("path") != kept) & ~new_original
    restated = ~c("_review").eqNullSafe(c("review_id")) | ~c("_version").eqNullSafe(c("version")) | ~c("_metadata").eqNullSafe(c("metadata")) | new_original
    action = (
        F.when(c("desired") & ~present, "ADD").when(c("desired") & elsewhere & ~c("local_code").eqNullSafe(c("code")), "MOVE")
        .when(c("desired") & (elsewhere | restated), "ADD").when(~c("desired") & present, "REMOVE")
    )
    suffix = F.lower(F.regexp_extract("path", _SUFFIX, 1))
    removed = F.concat(F.lit(f"_removed/{batch}/"), c("item_id").cast("string"), F.when(suffix.isin(*rules.IMAGE_SUFFIXES, ".image"), suffix).otherwise(c("suffix")))
    target = F.when(c("action") == "REMOVE", removed).when(present, kept).otherwise(fresh)
    # an ADD replaces what lies at another path only if the original changed
    previous = F.when(c("action").isin("MOVE", "REMOVE") | (present & new_original), c("path"))
    bound = F.when(c("action") == "REMOVE", F.coalesce("review_id", "latest_review_id", "_review")).otherwise(c("review_id"))
    mine = F.lit(True) if scope is None else (c("code") == scope) | F.coalesce(c("local_code") == scope, F.lit(False))
    rows = rows.withColumn("action", action).filter(c("action").isNotNull() & bound.isNotNull() & mine)
    return rows.select("item_id", bound.alias("review_id"), "code", "action", target.alias("target"), previous.alias("previous"))


def expire(batches: DataFrame, now: Column) -> DataFrame:
    """batches with pending ones past their time expired (batch_id, scope, status, expires_at)."""
    late = (F.col("status") == "pending") & (F.col("expires_at") <= now)
    return batches.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def scheduled(batches: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """batch_id, scope, item_id of pending items of live batches."""
    live = batches.filter((F.col("status") == "pending") & (F.col("expires_at") > now)).select("batch_id", "scope")
    return items.filter("status = 'pending'").select("batch_id", "item_id").join(live, "batch_id")


def create(deltas: DataFrame, batches: DataFrame, items: DataFrame, scope: str, now: Column, size: Column, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(result, rows) of making a batch of the deltas that no live batch holds yet.

    result is one row: status, n_items and expires_at of the batch. EXPORT_SCOPE_OVERLAP if live batches of another scope hold one of the deltas'
    items, NO_WORK if nothing is left, EXPORT_ROW_TOO_LARGE if the first row alone passes ``most_bytes``, else CREATED.
    rows, in the order of item (as text) and action, are empty unless CREATED: the longest prefix within both limits.
    """
    live = scheduled(expire(batches, now), items, now)
    overlap = live.filter(F.col("scope") != scope).join(deltas.select("item_id"), "item_id", "left_semi").limit(1)
    left = deltas.join(live.select("item_id"), "item_id", "left_anti").withColumn("_order", F.col("item_id").cast("string"))
    chunk = counts.bounded_chunk(left, ["_order", "action"], size, most_rows, most_bytes).drop("_order")
    rows = chunk.join(F.broadcast(overlap.select("scope")), F.lit(True), "left_anti")
    facts = left.limit(1).agg(F.count(F.lit(1)).alias("_left")).join(overlap.agg(F.count(F.lit(1)).alias("_overlap")), F.lit(True)).join(rows.agg(F.count(F.lit(1)).alias("n_items")), F.lit(True))
    status = F.when(F.col("_overlap") > 0, "EXPORT_SCOPE_OVERLAP").when(F.col("_left") == 0, "NO_WORK").when(F.col("n_items") == 0, "EXPORT_ROW_TOO_LARGE").otherwise("CREATED")
    return facts.select(status.alias("status"), "n_items", F.when(status == "CREATED", now + F.expr(f"INTERVAL {LIVE_FOR}")).alias("expires_at")), rows


def abandon(batches: DataFrame, batch: Column) -> DataFrame:
    """batches before one is made anew: it expires if pending; a completed one can't be (problem)."""
    it = F.col("batch_id") == batch
    return batches.withColumns({"problem": F.when(it & (F.col("status") == "completed"), "EXPORT_BATCH_COMPLETED"), "status": F.when(it & (F.col("status") == "pending"), "expired").otherwise(F.col("status"))})


def archive(batches: DataFrame, which: Column) -> DataFrame:
    """batches with the chosen ones archived; pending ones expire. Their items stay, so what was exported is still known."""
    now = F.coalesce(which, F.lit(False)) & ~F.col("archived")
    return batches.withColumns({"status": F.when(now & (F.col("status") == "pending"), "expired").otherwise(F.col("status")), "archived": F.col("archived") | now})


def receipt_rejections(stored: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """problem, n of a payload's items: any rejects the payload as a whole.

    stored: keys, action, status, sha256, target, path. payload: keys, status, sha256, path.
    """
    p = payload.select(*keys, F.col("status").alias("_status"), F.lower("sha256").alias("_sha"), F.col("path").alias("_path"), latest.nth(keys).alias("_nth"))
    j = p.join(stored.withColumn("_known", F.lit(True)), keys, "left")
    ok, was = F.col("_status") == "SUCCEEDED", F.col("status") == "SUCCEEDED"
    problem = (
        F.when(F.col("_known").isNull(), "RECEIPT_ITEM_NOT_IN_BATCH")
        .when(ok & ~F.coalesce(F.col("_sha").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "RECEIPT_HASH_INVALID")
        .when(ok & ~F.coalesce(rules.receipt_path_ok(F.col("_path"), F.col("target"), F.col("action")), F.lit(False)), "RECEIPT_PATH_INVALID")
        .when(was & (~ok | ~F.col("sha256").eqNullSafe(F.col("_sha")) | ~F.col("path").eqNullSafe(F.col("_path"))), "RECEIPT_SUCCESS_CONFLICT")
    )
    repeated = F.when(F.col("_nth") == 2, "RECEIPT_DUPLICATE_ITEM")
    return j.select(F.explode(F.array_compact(F.array(problem, repeated))).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def accepted(payload: DataFrame, rejections: DataFrame) -> DataFrame:
    """The payload, or no row of it if there is a rejection."""
    return payload.join(F.broadcast(rejections.select("problem").limit(1)), F.lit(True), "left_anti")


def receipt_state(after: DataFrame, payload: DataFrame, batch_keys: list[str], keys: list[str]) -> DataFrame:
    """Per batch: status, n_accepted, n_pending. after: the items with the receipt applied."""
    took = payload.filter("status = 'SUCCEEDED'").select(*keys, F.lit(True).alias("_took"))
    pending = F.count_if(F.col("status") != "SUCCEEDED")
    rows = after.join(took, keys, "left").groupBy(*batch_keys).agg(F.count("_took").alias("n_accepted"), pending.alias("n_pending"))
    return rows.select(*batch_keys, F.when(F.col("n_pending") > 0, "pending").otherwise("completed").alias("status"), "n_accepted", "n_pending")


def receipt_lists(after: DataFrame, payload: DataFrame, keys: list[str]) -> DataFrame:
    """keys, list of the items a response names: accepted (a success in the payload) and pending, as rows."""
    took = payload.filter("status = 'SUCCEEDED'").select(*keys, latest.nth(keys).alias("_nth")).filter("_nth = 1").select(*keys, F.lit("accepted").alias("list"))
    return took.unionByName(after.filter("status <> 'SUCCEEDED'").select(*keys).withColumn("list", F.lit("pending")))


def receipt_against_manifest(receipt: DataFrame, manifest: DataFrame, keys: list[str], *, cancelled: bool) -> DataFrame:
    """problem, n: items of a receipt that aren't the manifest's at their place, and missing ones unless it was cancelled.

    Both: position (from 0), keys. A join on positions, so neither side is collected.
    """
    m = manifest.select("position", *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_m"))
    j = receipt.select("position", *keys, F.lit(True).alias("_r")).join(m, "position", "full")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    missing = F.col("_r").isNull() & ~F.lit(cancelled)
    problem = F.when(missing, "COUNT_MISMATCH").when(F.col("_r") & (F.col("_m").isNull() | ~same), "ITEM_MISMATCH")
    return j.select(problem.alias("problem")).filter("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def list_problems(manifest: DataFrame, succeeded: DataFrame, took: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """problem, n: accepted items that didn't succeed, pending ones not in the manifest, items in both lists."""
    k = [key]
    took, pending = took.select(key).distinct(), pending.select(key).distinct()
    said = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    return (
        said(took.join(succeeded, k, "left_anti"), "ACCEPTED_NOT_SUCCEEDED")
        .unionAll(said(pending.join(manifest, k, "left_anti"), "PENDING_NOT_IN_MANIFEST"))
        .unionAll(said(took.join(pending, k, "left_semi"), "IN_BOTH"))
    )
