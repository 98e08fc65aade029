"""The registered queries of the review, import, export and evaluation operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import scores, text, urls
from siltstone.operators import classify, counts, latest, metrics, progress, sync, transitions
from siltstone.plans import views as v
from siltstone.plans.views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_ACTIVE = "FROM item JOIN category USING (category_id) LEFT JOIN current_review USING (item_id) WHERE item.active AND category.active"


@query(sql(f"""SELECT total, reviewed, open, greatest(0, total - reviewed - open) AS pending, reviewed / total AS share, round_even(reviewed / total * 100, 2) AS percent FROM (
    SELECT count(*) AS total, count(review_id) AS reviewed, count(*) FILTER (review_id IS NULL AND open_member IS NOT NULL) AS open {_ACTIVE})"""))
def progress_overview(s: SparkSession, d: str) -> DataFrame:
    return progress.overview(v.item(s, d), v.category(s, d), v.current_review(s, d))


@query(sql(f"SELECT d.decision, coalesce(n, 0) AS n FROM (VALUES ('APPROVED'), ('REJECTED'), ('UNSURE')) AS d(decision) LEFT JOIN (SELECT decision, count(*) AS n {_ACTIVE} GROUP BY decision) USING (decision)"))
def progress_decisions(s: SparkSession, d: str) -> DataFrame:
    return progress.decisions(v.item(s, d), v.category(s, d), v.current_review(s, d))


DAY = "1996-03-15"


@query(sql(f"""SELECT CAST(m.member AS BIGINT) AS member, count(review_id) AS attempts, count(*) FILTER (decision = 'APPROVED') AS approved, count(*) FILTER (decision = 'REJECTED') AS rejected,
    count(*) FILTER (decision = 'UNSURE') AS unsure, count(*) FILTER (created_at >= TIMESTAMP '{DAY}' AND created_at < TIMESTAMP '{DAY}' + INTERVAL 1 DAY) AS today
    FROM range({v.MEMBERS}) AS m(member) LEFT JOIN review USING (member) GROUP BY m.member"""))
def progress_members(s: SparkSession, d: str) -> DataFrame:
    return progress.members(v.review(s, d), v.MEMBERS, DAY)


@query(sql(f"SELECT item_id, category_id {_ACTIVE} AND review_id IS NULL AND open_member IS NULL"))
def eligible_items(s: SparkSession, d: str) -> DataFrame:
    return progress.eligible(v.item(s, d), v.category(s, d), v.current_review(s, d)).select("item_id", "category_id")


@query(sql("SELECT item_id, source FROM item WHERE EXISTS (SELECT 1 FROM current_review c WHERE c.item_id = item.item_id AND decision = 'APPROVED')"))
def reviewed_items_semi(s: SparkSession, d: str) -> DataFrame:
    return v.item(s, d).join(v.current_review(s, d).filter("decision = 'APPROVED'"), "item_id", "left_semi").select("item_id", "source")


@query(sql("SELECT item_id, record_id, source, name FROM item JOIN category USING (category_id) WHERE source = 'BUILDING' AND item.active AND (record_id ILIKE '%1%' OR name ILIKE '%an%') ORDER BY item_id LIMIT 50 OFFSET 2"))
def item_search_page(s: SparkSession, d: str) -> DataFrame:
    rows = v.item(s, d).filter(progress.conditions(source="BUILDING", active=True, open_member=None)).join(v.category(s, d).select("category_id", "name"), "category_id")
    found = rows.filter(progress.any_contains(["record_id"], "1") | progress.any_contains(["name"], "an"))
    return progress.page(found, [F.col("item_id")], limit=50, offset=2).select("item_id", "record_id", "source", "name")


@query(sql("SELECT review_id, item_id, code, decision, created_at FROM review JOIN item USING (item_id) JOIN category USING (category_id) WHERE member = 2 AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01' ORDER BY created_at DESC, review_id DESC LIMIT 100"))
def history_page(s: SparkSession, d: str) -> DataFrame:
    rows = progress.history(v.review(s, d).filter(progress.conditions(member=2) & progress.between_days("created_at", "1995-01-01", "1996-12-31")), v.item(s, d), v.category(s, d))
    return progress.page(rows, [F.desc("created_at"), F.desc("review_id")], limit=100).select("review_id", "item_id", "code", "decision", "created_at")


@query(sql("SELECT DISTINCT code, name, source FROM review JOIN item USING (item_id) JOIN category USING (category_id) WHERE member = 2"))
def history_facets(s: SparkSession, d: str) -> DataFrame:
    return progress.history(v.review(s, d).filter(progress.conditions(member=2)), v.item(s, d), v.category(s, d)).select("code", "name", "source").distinct()


@query(sql("SELECT review_id, item_id, code, 'member-' || CAST(member AS VARCHAR) AS member_name, decision FROM review JOIN item USING (item_id) JOIN category USING (category_id) WHERE item.active"))
def admin_reviews_4way(s: SparkSession, d: str) -> DataFrame:
    names = s.range(v.MEMBERS).select(F.col("id").alias("member"), F.concat(F.lit("member-"), F.col("id").cast("string")).alias("member_name"))
    return progress.history(v.review(s, d), v.item(s, d), v.category(s, d)).filter("item_active").join(F.broadcast(names), "member").select("review_id", "item_id", "code", "member_name", "decision")


@query(sql("SELECT item_id, code, open_member FROM item JOIN category USING (category_id) WHERE open_member IS NOT NULL AND item_id NOT IN (SELECT item_id FROM current_review)"))
def open_items(s: SparkSession, d: str) -> DataFrame:
    rows = v.item(s, d).filter("open_member IS NOT NULL").join(v.category(s, d).select("category_id", "code"), "category_id")
    return rows.join(v.current_review(s, d), "item_id", "left_anti").select("item_id", "code", "open_member")


@query(sql("""SELECT code, active, sort_order, coalesce(n_items, 0) AS n_items, coalesce(by_source, '') AS by_source FROM category LEFT JOIN (
    SELECT category_id, CAST(sum(n) AS BIGINT) AS n_items, string_agg(source || '=' || CAST(n AS VARCHAR), ';' ORDER BY source) AS by_source FROM (SELECT category_id, source, count(*) AS n FROM item GROUP BY ALL) GROUP BY category_id) USING (category_id)"""))
def category_counts(s: SparkSession, d: str) -> DataFrame:
    rows = progress.category_counts(v.item(s, d), v.category(s, d))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("by_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.select("code", "active", "sort_order", "n_items", said.alias("by_source"))


@query(sql("SELECT DISTINCT source FROM item"))
def source_catalog(s: SparkSession, d: str) -> DataFrame:
    return progress.source_catalog(v.item(s, d))


@query(sql("SELECT item_id, review_id, decision FROM review QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, review_id DESC) = 1"))
def latest_review(s: SparkSession, d: str) -> DataFrame:
    return latest.first_by(v.review(s, d), ["item_id"], [F.desc("created_at"), F.desc("review_id")]).select("item_id", "review_id", "decision")


_NEWEST = "row_number() OVER (PARTITION BY item_id ORDER BY succeeded_at DESC NULLS FIRST, review_id DESC, line DESC, part DESC, supplier DESC) = 1"
_LATEST_LOCAL = f"latest_local AS (SELECT * FROM local_item WHERE succeeded QUALIFY {_NEWEST})"


@query(sql("SELECT item_id, action, review_id, action <> 'REMOVE' AS present FROM latest_local", _LATEST_LOCAL))
def latest_local_state(s: SparkSession, d: str) -> DataFrame:
    return sync.latest_local(v.local_item(s, d)).select("item_id", "action", "review_id", (F.col("action") != "REMOVE").alias("present"))


@query(sql("""SELECT digest, row FROM (SELECT identity, row, sha256(category || CAST(url AS VARCHAR)) AS digest, row % 7 <> 0 AS present FROM manifest QUALIFY row_number() OVER (PARTITION BY identity ORDER BY row DESC) = 1)
    WHERE present QUALIFY row_number() OVER (PARTITION BY digest ORDER BY row DESC) = 1"""))
def content_dedupe_latest(s: SparkSession, d: str) -> DataFrame:
    rows = v.manifest(s, d).select("identity", "row", F.sha2(F.concat("category", F.col("url").cast("string")), 256).alias("digest"))
    return latest.present_with(rows, "identity", "digest", [F.desc("row")], F.col("row") % 7 != 0).select("digest", "row")


@query(sql("SELECT category, url, min(row) AS row FROM manifest GROUP BY category, url"))
def first_wins_dedupe(s: SparkSession, d: str) -> DataFrame:
    return latest.first_wins(v.manifest(s, d), ["category", "url"], "row").select("category", "url", "row")


@query(sql("SELECT category, url, row, earlier FROM manifest QUALIFY row_number() OVER (PARTITION BY category, url ORDER BY NOT earlier, row) = 1"))
def resume_merge(s: SparkSession, d: str) -> DataFrame:
    m = v.manifest(s, d)
    return latest.resume_merge(m.filter("earlier"), m.filter("NOT earlier"), ["category", "url"], "row").select("category", "url", "row", "earlier")


_KNOWN = "known AS (SELECT row, category, identity, url, material, category <> 'es' AS valid FROM manifest WHERE NOT earlier)"
_OLD = "old AS (SELECT * FROM manifest WHERE earlier QUALIFY row_number() OVER (PARTITION BY identity ORDER BY row) = 1)"
_STEP = """step AS (SELECT *, first_value(row) OVER w AS f_row, first_value(material) OVER w AS f_material FROM known WHERE valid WINDOW w AS (PARTITION BY identity ORDER BY row))"""
_JUDGED = """judged AS (SELECT s.row, s.category, s.identity, s.url, CASE WHEN s.row <> f_row THEN CASE WHEN s.material = f_material THEN 'EXACT_DUPLICATE' ELSE 'CONFLICTING_SOURCE_IDENTITY' END
    WHEN o.row IS NOT NULL THEN CASE WHEN s.material = o.material THEN 'EXACT_DUPLICATE' ELSE 'CONFLICTING_SOURCE_IDENTITY' END END AS outcome, CASE WHEN s.row <> f_row AND s.material = f_material THEN f_row END AS related_row FROM step s LEFT JOIN old o USING (identity))"""
_LEFT = """remaining AS (SELECT j.*, first_value(row) OVER w AS f_row, first_value(category) OVER w AS f_category, lo, hi FROM (SELECT * FROM judged WHERE outcome IS NULL) j
    LEFT JOIN (SELECT url, min(category) AS lo, max(category) AS hi FROM old GROUP BY url) u USING (url) WINDOW w AS (PARTITION BY url ORDER BY row))"""
_CLASSIFIED = """classified AS (SELECT row, category, identity, url, 'INVALID_SPECIES' AS outcome, CAST(NULL AS BIGINT) AS related_row FROM known WHERE NOT valid UNION ALL SELECT row, category, identity, url, outcome, related_row FROM judged WHERE outcome IS NOT NULL
    UNION ALL SELECT row, category, identity, url, CASE WHEN lo IS NOT NULL THEN CASE WHEN lo = category AND hi = category THEN 'DUPLICATE_IMAGE_URL' ELSE 'CONFLICTING_IMAGE_SPECIES' END WHEN row = f_row THEN 'NEW'
    WHEN category = f_category THEN 'DUPLICATE_IMAGE_URL' ELSE 'CONFLICTING_IMAGE_SPECIES' END, CASE WHEN lo IS NULL AND row <> f_row THEN f_row END FROM remaining)"""
_ISSUES = "issues AS (SELECT row, related_row, outcome AS code, outcome NOT IN ('DUPLICATE_IMAGE_URL', 'EXACT_DUPLICATE') AS blocking FROM classified WHERE outcome <> 'NEW')"
_IMPORT = (_KNOWN, _OLD, _STEP, _JUDGED, _LEFT, _CLASSIFIED, _ISSUES)


def _classified(s: SparkSession, d: str) -> DataFrame:
    m = v.manifest(s, d)
    existing = latest.first_wins(m.filter("earlier"), ["identity"], "row")
    return classify.classify(m.filter("NOT earlier"), existing, m.select("category").filter("category <> 'es'").distinct())


@query(sql("SELECT row, outcome, related_row FROM classified", *_IMPORT))
def import_classify(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).select("row", "outcome", "related_row")


@query(sql("SELECT category, outcome, count(*) AS n FROM classified GROUP BY category, outcome", *_IMPORT))
def import_counts(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).groupBy("category", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT code, blocking, n, greatest(n - 10, 0) AS omitted, samples FROM (SELECT code, blocking, count(*) AS n, string_agg(CAST(row AS VARCHAR) || ':' || coalesce(CAST(related_row AS VARCHAR), ''), ';' ORDER BY row) FILTER (k <= 10) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY row) AS k FROM issues) GROUP BY code, blocking)""", *_IMPORT))
def issue_groups(s: SparkSession, d: str) -> DataFrame:
    groups = counts.issue_groups(classify.issues(_classified(s, d)))
    said = F.array_join(F.transform("samples", lambda x: F.concat(x["row"].cast("string"), F.lit(":"), F.coalesce(x["related_row"].cast("string"), F.lit("")))), ";")
    return groups.select("code", "blocking", "n", "omitted", said.alias("samples"))


@query(sql("""SELECT row, code, blocking FROM kept WHERE NOT evicted UNION ALL SELECT row, code, blocking FROM entering WHERE place <= (SELECT count(*) FROM kept WHERE NOT blocking)""", *_IMPORT,
    "numbered AS (SELECT *, row_number() OVER (ORDER BY row) AS k FROM issues)", "entering AS (SELECT *, row_number() OVER (ORDER BY row) AS place FROM numbered WHERE k > 100 AND blocking)",
    "kept AS (SELECT *, NOT blocking AND row_number() OVER (PARTITION BY blocking ORDER BY row DESC) <= (SELECT count(*) FROM entering) AS evicted FROM numbered WHERE k <= 100)"))
def issue_details_bounded(s: SparkSession, d: str) -> DataFrame:
    return counts.bounded_details(classify.issues(_classified(s, d))).select("row", "code", "blocking")


@query(sql("""SELECT coalesce(k.identity, '__OTHER__') AS identity, CAST(sum(n) AS BIGINT) AS n FROM (SELECT identity, count(*) AS n, min(row) AS f FROM manifest GROUP BY identity) c
    LEFT JOIN (SELECT identity FROM manifest GROUP BY identity ORDER BY min(row), identity LIMIT 50) k USING (identity) GROUP BY 1"""))
def capped_counts(s: SparkSession, d: str) -> DataFrame:
    return counts.capped_counts(v.manifest(s, d), "identity", "row", most=50)


_WANTED = "wanted AS (SELECT item_id, code, review_id, coalesce(item.active AND category.active AND decision = 'APPROVED', FALSE) AS desired FROM item JOIN category USING (category_id) LEFT JOIN current_review USING (item_id))"
_LOCAL = "remote AS (SELECT item_id, action, CASE WHEN line = 1 THEN 'N000' ELSE code END AS local_code, l.review_id, original_changed, CASE WHEN part % 3 = 0 THEN '.jpg' ELSE '.png' END AS suffix FROM latest_local l JOIN item USING (item_id) JOIN category USING (category_id))"
_DELTA = """delta AS (SELECT item_id, code, action, CASE WHEN action = 'REMOVE' THEN '_removed/' || item_id || suffix WHEN NOT present OR changed THEN 'images/' || code || '/' || item_id || suffix ELSE 'images/' || code || '/' || item_id || suffix END AS target,
    CASE WHEN action IN ('MOVE', 'REMOVE') OR (present AND changed) THEN previous END AS previous FROM (SELECT *, CASE WHEN desired AND NOT present THEN 'ADD' WHEN desired AND changed THEN 'ADD' WHEN desired AND local_code <> code THEN 'MOVE'
    WHEN desired AND review_id IS DISTINCT FROM local_review THEN 'ADD' WHEN NOT desired AND present THEN 'REMOVE' END AS action FROM (SELECT w.item_id, w.code, w.desired, w.review_id, r.local_code, r.review_id AS local_review, coalesce(r.original_changed, FALSE) AS changed,
    coalesce(r.suffix, '.image') AS suffix, coalesce(r.action <> 'REMOVE', FALSE) AS present, 'images/' || r.local_code || '/' || w.item_id || coalesce(r.suffix, '.image') AS previous FROM wanted w LEFT JOIN remote r USING (item_id))) WHERE action IS NOT NULL)"""
_DELTAS = (_LATEST_LOCAL, _WANTED, _LOCAL, _DELTA)


def _wanted(s: SparkSession, d: str) -> DataFrame:
    rows = v.item(s, d).join(v.category(s, d).select("category_id", "code", F.col("active").alias("_c")), "category_id").join(v.current_review(s, d).select("item_id", "review_id", "decision"), "item_id", "left")
    return rows.select("item_id", "code", "review_id", F.coalesce(F.col("active") & F.col("_c") & (F.col("decision") == "APPROVED"), F.lit(False)).alias("desired"))


def _remote(s: SparkSession, d: str) -> DataFrame:
    rows = sync.latest_local(v.local_item(s, d)).join(v.item(s, d).select("item_id", "category_id"), "item_id").join(v.category(s, d).select("category_id", "code"), "category_id")
    return rows.select("item_id", "action", F.when(F.col("line") == 1, "N000").otherwise(F.col("code")).alias("local_code"), "review_id", "original_changed", F.when(F.col("part") % 3 == 0, ".jpg").otherwise(".png").alias("suffix"))


@query(sql("SELECT item_id, action, target, previous FROM delta", *_DELTAS))
def derive_deltas(s: SparkSession, d: str) -> DataFrame:
    return sync.deltas(_wanted(s, d), _remote(s, d))


_PENDING = "pending AS (SELECT item_id, code FROM local_item JOIN item USING (item_id) JOIN category USING (category_id) WHERE NOT succeeded AND succeeded_at >= TIMESTAMP '1998-06-01' QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY review_id, line, part, supplier) = 1)"


@query(sql("SELECT c.code, coalesce(n, 0) AS n FROM category c LEFT JOIN (SELECT code, count(*) AS n FROM (SELECT code FROM pending UNION ALL SELECT code FROM delta WHERE item_id NOT IN (SELECT item_id FROM pending)) GROUP BY code) USING (code) WHERE c.active", *_DELTAS, _PENDING))
def pending_counts(s: SparkSession, d: str) -> DataFrame:
    codes = v.item(s, d).select("item_id", "category_id").join(v.category(s, d).select("category_id", "code"), "category_id").select("item_id", "code")
    waiting = v.local_item(s, d).filter(~F.col("succeeded") & (F.col("succeeded_at") >= F.lit("1998-06-01").cast("timestamp_ntz")))
    pending = latest.first_by(waiting, ["item_id"], [F.col(c) for c in ("review_id", "line", "part", "supplier")]).join(codes, "item_id").select("item_id", "code")
    delta = sync.deltas(_wanted(s, d), _remote(s, d)).join(codes, "item_id")
    return sync.pending_counts(pending, delta, v.category(s, d))


@query(sql("""SELECT row, bytes, running_bytes FROM (SELECT row, bytes, CAST(sum(bytes) OVER (ORDER BY row) AS BIGINT) + 64 AS running_bytes FROM (SELECT doc_id AS row, CAST(strlen(text) AS BIGINT) AS bytes FROM documents ORDER BY doc_id LIMIT 10000)) WHERE running_bytes <= 1000000"""))
def bounded_chunk(s: SparkSession, d: str) -> DataFrame:
    docs = v.table(s, d, "documents").select(F.col("doc_id").alias("row"), F.octet_length("text").alias("_n"))
    return counts.bounded_chunk(docs, ["row"], F.col("_n"), most_rows=10_000, most_bytes=1_000_000, header=64).select("row", "bytes", "running_bytes")


_STORED = "stored AS (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS e, CASE WHEN l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status, CASE WHEN l_linestatus = 'F' THEN md5(CAST(l_partkey AS VARCHAR)) END AS sha256, CAST(NULL AS VARCHAR) AS error FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity) = 1)"
_PAYLOAD = "payload AS (SELECT a, b, c, e, CASE WHEN status = 'SUCCEEDED' OR c % 3 > 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, CASE WHEN status = 'SUCCEEDED' OR c % 3 > 0 THEN md5(CAST(c AS VARCHAR)) END AS sha256 FROM stored WHERE a % 2 = 0)"


def _receipt(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    keys = ["a", "b", "c", "e"]
    lines = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("e"), (F.col("l_linestatus") == "F").alias("done"), "l_shipdate", "l_quantity")
    lines = latest.first_by(lines, keys, [F.col("l_shipdate"), F.col("l_quantity")])
    digest = F.md5(F.col("c").cast("string").cast("binary"))
    stored = lines.select(*keys, F.when(F.col("done"), "SUCCEEDED").otherwise("PENDING").alias("status"), F.when(F.col("done"), digest).alias("sha256"), F.lit(None).cast("string").alias("error"))
    ok = (F.col("status") == "SUCCEEDED") | (F.col("c") % 3 > 0)
    payload = stored.filter(F.col("a") % 2 == 0).select(*keys, F.when(ok, "SUCCEEDED").otherwise("FAILED").alias("status"), F.when(ok, digest).alias("sha256"))
    return stored, payload, keys


@query(sql("""SELECT a, b, c, e, CASE WHEN s.status = 'SUCCEEDED' OR p.status = 'SUCCEEDED' THEN 'SUCCEEDED' ELSE s.status END AS status, CASE WHEN s.status = 'SUCCEEDED' THEN s.sha256 WHEN p.status = 'SUCCEEDED' THEN p.sha256 END AS sha256,
    CASE WHEN s.status <> 'SUCCEEDED' AND p.status = 'FAILED' THEN 'SYNC_FAILED' END AS error FROM stored s LEFT JOIN payload p USING (a, b, c, e)""", _STORED, _PAYLOAD))
def apply_receipt(s: SparkSession, d: str) -> DataFrame:
    return sync.apply_receipt(*_receipt(s, d))


@query(sql("SELECT 'REPEATED' AS problem, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'UNKNOWN', 0 UNION ALL SELECT 'CHANGED_SUCCESS', 0 UNION ALL SELECT 'FAILED_AFTER_SUCCESS', count(*) FROM stored s JOIN payload p USING (a, b, c, e) WHERE s.status = 'SUCCEEDED' AND p.status = 'FAILED'", _STORED, _PAYLOAD))
def receipt_problems(s: SparkSession, d: str) -> DataFrame:
    return sync.receipt_problems(*_receipt(s, d))


_VERSIONED = "versioned AS (SELECT item_id, review_id AS version, CASE WHEN action = 'MOVE' THEN 'ADD' ELSE action END AS action, CAST(part AS VARCHAR) AS path, succeeded FROM local_item QUALIFY row_number() OVER (PARTITION BY item_id, succeeded ORDER BY review_id DESC, line DESC, part DESC, supplier DESC, succeeded_at DESC) = 1)"


def _versioned(s: SparkSession, d: str) -> DataFrame:
    rows = latest.first_by(v.local_item(s, d), ["item_id", "succeeded"], [F.desc(c) for c in ("review_id", "line", "part", "supplier", "succeeded_at")])
    return rows.select("item_id", F.col("review_id").alias("version"), F.when(F.col("action") == "MOVE", "ADD").otherwise(F.col("action")).alias("action"), F.col("part").cast("string").alias("path"), "succeeded")


@query(sql("""SELECT item_id, CASE WHEN outcome IN ('REPLACED', 'ADDED', 'REMOVED') THEN ov ELSE cv END AS version, CASE WHEN outcome IN ('REPLACED', 'ADDED', 'REMOVED') THEN op ELSE cp END AS path, outcome FROM (
    SELECT coalesce(c.item_id, o.item_id) AS item_id, c.version AS cv, c.path AS cp, o.version AS ov, o.path AS op, CASE WHEN o.version IS NULL THEN 'UNCHANGED' WHEN o.version < c.version THEN 'SKIPPED'
    WHEN o.version = c.version THEN CASE WHEN o.action <> 'REMOVE' AND o.path = c.path THEN 'REPEATED' ELSE 'CONFLICT' END WHEN o.action = 'REMOVE' THEN 'REMOVED' WHEN c.version IS NOT NULL THEN 'REPLACED' ELSE 'ADDED' END AS outcome
    FROM (SELECT * FROM versioned WHERE succeeded AND action <> 'REMOVE') c FULL JOIN (SELECT * FROM versioned WHERE NOT succeeded) o ON c.item_id = o.item_id)""", _VERSIONED))
def canonical_merge(s: SparkSession, d: str) -> DataFrame:
    rows = _versioned(s, d)
    canonical = rows.filter("succeeded AND action <> 'REMOVE'").select("item_id", "version", "path")
    return sync.canonical_merge(canonical, rows.filter("NOT succeeded").drop("succeeded"), ["path"])


@query(sql("SELECT item_id, o.version, o.action, coalesce(o.version > r.version OR (o.version = r.version AND o.action = r.action), TRUE) AS accepted FROM (SELECT * FROM versioned WHERE NOT succeeded) o LEFT JOIN (SELECT * FROM versioned WHERE succeeded) r USING (item_id)", _VERSIONED))
def generation_fence(s: SparkSession, d: str) -> DataFrame:
    rows = _versioned(s, d)
    return sync.fence(rows.filter("NOT succeeded").select("item_id", "version", "action"), rows.filter("succeeded"))


@query(sql("SELECT i.item_id, 1 + greatest(coalesce(r.v, 0), coalesce(l.v, 0), coalesce(p.v, 0)) AS generation FROM item i LEFT JOIN (SELECT item_id, max(review_id) AS v FROM review GROUP BY 1) r USING (item_id) LEFT JOIN (SELECT item_id, max(line) AS v FROM local_item GROUP BY 1) l USING (item_id) LEFT JOIN (SELECT item_id, max(part) AS v FROM local_item GROUP BY 1) p USING (item_id)"))
def epoch_generation(s: SparkSession, d: str) -> DataFrame:
    local = v.local_item(s, d)
    return sync.epoch(v.item(s, d), (v.review(s, d), "item_id", "review_id"), (local, "item_id", "line"), (local, "item_id", "part"))


@query(sql("SELECT 'missing' AS side, count(*) AS n FROM (SELECT item_id, decision FROM review EXCEPT SELECT item_id, decision FROM current_review) UNION ALL SELECT 'added', count(*) FROM (SELECT item_id, decision FROM current_review EXCEPT SELECT item_id, decision FROM review)"))
def copy_verification(s: SparkSession, d: str) -> DataFrame:
    return counts.copy_differences(v.review(s, d).select("item_id", "decision"), v.current_review(s, d).select("item_id", "decision"))


@query(sql("SELECT item_id, review_id, CASE WHEN row_number() OVER (PARTITION BY item_id ORDER BY created_at, review_id) = 1 THEN 'pending' ELSE 'expired' END AS status FROM review"))
def scope_rank(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("item_id").orderBy("created_at", "review_id"))
    return v.review(s, d).select("item_id", "review_id", F.when(n == 1, "pending").otherwise("expired").alias("status"))


_REASONS = ("WRONG_SPECIES", "NOT_WHOLE_FISH", "NOT_A_FISH", "OTHER")


@query(sql("""SELECT review_id, CASE WHEN decision = 'APPROVED' THEN 'YES' WHEN r = 1 OR r = 2 THEN 'NO' ELSE 'REVIEW' END AS whole, CASE WHEN decision = 'APPROVED' THEN 'YES' WHEN r = 0 OR r = 2 THEN 'NO' ELSE 'REVIEW' END AS exact,
    CASE WHEN decision <> 'REJECTED' THEN NULL WHEN r = 3 AND item_id % 2 = 0 THEN 'NOTES_REQUIRED' END AS problem FROM (SELECT *, CASE WHEN decision = 'REJECTED' THEN review_id % 4 END AS r FROM review)"""))
def decision_facts(s: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("decision") == "REJECTED", F.element_at(F.array(*[F.lit(r) for r in _REASONS]), (F.col("review_id") % 4 + 1).cast("int")))
    notes = F.when(F.col("item_id") % 2 == 1, "said why").otherwise("  ")
    return v.review(s, d).select("review_id", F.inline(F.array(progress.facts(F.col("decision"), reason))), progress.decision_problem(F.col("decision"), reason, notes).alias("problem"))


@query(sql(r"SELECT review_id, CASE WHEN item_id % 5 = 0 THEN NULL WHEN item_id % 5 = 1 THEN NULL ELSE 'seen ' || decision || chr(10) || 'twice' END AS notes FROM review"))
def kept_notes(s: SparkSession, d: str) -> DataFrame:
    """Notes of reviews as they are kept: without white space around them, null if nothing else is in them."""
    i = F.col("item_id")
    raw = F.when(i % 5 == 1, " \t\n").when(i % 5 > 1, F.concat(F.lit("\n seen "), F.col("decision"), F.lit("\ntwice\u2003 \t")))
    return v.review(s, d).select("review_id", progress.decision_notes(raw).alias("notes"))


_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"""SELECT page_id, 'https://' || lower({_HOST}) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS canonical, lower({_HOST}) AS host, ends_with(lower({_HOST}), '.org') OR lower({_HOST}) = 'org' AS allowed FROM pages WHERE regexp_matches(url, '^https?://')""")
def url_normalize(s: SparkSession, d: str) -> DataFrame:
    pages = v.table(s, d, "pages").select("page_id", "url").filter(urls.is_web("url"))
    return pages.select("page_id", urls.without_query("url").alias("canonical"), urls.host("url").alias("host"), urls.host_allowed(urls.host("url"), [".org"]).alias("allowed"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS plain, len(regexp_extract_all(html, '<[aA][ \t\n]')) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def html_text(s: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return v.table(s, d, "pages").select("page_id", text.strip_tags(html).alias("plain"), F.regexp_count(html, F.lit(r"<[aA][ \t\n]")).cast("long").alias("n_links"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT doc_id, upper(lang) || '-' || substr(sha256(upper(lang) || '|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 16) AS stable_id, sha256('{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    docs = v.table(s, d, "documents")
    return docs.select("doc_id", text.stable_id(F.upper("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("stable_id"), text.fingerprint("lang", "n_chars", "source").alias("fingerprint"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS bucket, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS unexpired FROM events GROUP BY 1, 2")
def json_props(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    live = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return v.table(s, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("unexpired"))


@query("""SELECT key, ts, seq, streak, streak >= 5 AS locked, CASE WHEN streak >= 5 THEN ts + INTERVAL 5 MINUTE END AS locked_until FROM (SELECT *, count(*) FILTER (failure) OVER (PARTITION BY key, part ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak FROM (
    SELECT *, sum(CASE WHEN last IS NULL OR cleared OR ts - last >= INTERVAL 20 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM (
    SELECT user_id % 40 AS key, ts, event_id AS seq, event_type = 'error' AS failure, lag(ts) OVER w AS last, lag(event_type = 'signup') OVER w AS cleared FROM events WHERE event_type IN ('error', 'signup') WINDOW w AS (PARTITION BY user_id % 40 ORDER BY ts, event_id)))) WHERE failure""")
def failure_lock(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    attempts = v.table(s, d, "events").select((F.col("user_id") % 40).alias("key"), "ts", F.col("event_id").alias("seq"), (kind == "error").alias("failure"), (kind == "signup").alias("success"))
    return sync.failure_locks(attempts, "20 DAYS")


_LOGITS = "logits AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)"
_RANKED = "ranked AS (SELECT vec_id, label, i - 1 AS class, z[i] AS logit, row_number() OVER (PARTITION BY vec_id ORDER BY z[i] DESC, i) AS rank, exp(z[i] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM logits, range(1, 11) AS r(i))"
_BEST = "best AS (SELECT vec_id, label, class AS predicted, p AS confidence FROM ranked WHERE rank = 1)"


def _predictions(s: SparkSession, d: str) -> DataFrame:
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return v.table(s, d, "embeddings").select("vec_id", "label", scores.ranked(z).alias("ranked"))


def _best(s: SparkSession, d: str) -> DataFrame:
    top = F.col("ranked")[0]
    return _predictions(s, d).select("vec_id", "label", top["class"].alias("predicted"), top["confidence"].alias("confidence"))


@query(f"WITH {_LOGITS}, {_RANKED} SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(class AS INTEGER) AS class, round(p, 9) AS confidence, CASE WHEN max(p) OVER (PARTITION BY vec_id) >= 0.11 THEN 'CANDIDATES' ELSE 'LOW_CONFIDENCE' END AS status FROM ranked WHERE rank <= 3")
def softmax_topk(s: SparkSession, d: str) -> DataFrame:
    rows = _predictions(s, d).select("vec_id", scores.status(F.col("ranked"), 0.11).alias("status"), F.posexplode(F.slice("ranked", 1, 3)).alias("pos", "r"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("r.class").alias("class"), F.round("r.confidence", 9).alias("confidence"), "status")


@query(f"WITH {_LOGITS}, {_RANKED}, {_BEST} SELECT label, {', '.join(f'count(*) FILTER (predicted = {i}) AS p{i}' for i in range(10))} FROM best GROUP BY label")
def confusion_matrix(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_best(s, d), range(10))


@query(f"""WITH {_LOGITS}, {_RANKED}, {_BEST}, c AS (SELECT l.label AS class, count(*) FILTER (b.label = l.label AND predicted = l.label) AS tp, count(*) FILTER (predicted = l.label) AS said, count(*) FILTER (b.label = l.label) AS support FROM best b, (SELECT DISTINCT label FROM embeddings) l GROUP BY 1)
    SELECT class, support, tp / nullif(said, 0) AS "precision", tp / nullif(support, 0) AS recall, 2 * tp / nullif(said + support, 0) AS f1 FROM c""")
def class_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.by_class(_best(s, d))


@query(f"""WITH {_LOGITS}, {_RANKED}, {_BEST}, c AS (SELECT l.label AS class, count(*) FILTER (b.label = l.label AND predicted = l.label) AS tp, count(*) FILTER (predicted = l.label) AS said, count(*) FILTER (b.label = l.label) AS support FROM best b, (SELECT DISTINCT label FROM embeddings) l GROUP BY 1)
    SELECT count(*) AS n, round(count(*) FILTER (predicted = label) / count(*), 9) AS accuracy, (SELECT round(avg(coalesce(2 * tp / nullif(said + support, 0), 0)), 9) FROM c) AS macro_f1, round((SELECT count(*) FROM ranked WHERE rank <= 3 AND class = label) / count(*), 9) AS top_rate FROM best""")
def overall_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = _predictions(s, d).select("label", F.col("ranked")[0]["class"].alias("predicted"), F.transform("ranked", lambda r: r["class"].cast("long")).alias("ranked"))
    return metrics.overall(rows.withColumn("label", F.col("label").cast("long"))).select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "top_rate")])


_SWEEP = [round(0.105 + 0.005 * i, 3) for i in range(14)]


@query(f"WITH {_LOGITS}, {_RANKED}, {_BEST} SELECT t AS threshold, count(*) FILTER (confidence >= t) AS n_above, count(*) FILTER (confidence >= t) / count(*) AS coverage, count(*) FILTER (confidence >= t AND predicted = label) / nullif(count(*) FILTER (confidence >= t), 0) AS \"precision\" FROM best, (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in _SWEEP)}) AS s(t) GROUP BY t")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return metrics.sweep(_best(s, d), _SWEEP)


@query("SELECT label AS class, n, round(1 / sqrt(n) / avg(1 / sqrt(n)) OVER (), 9) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def class_weights(s: SparkSession, d: str) -> DataFrame:
    return metrics.class_weights(v.table(s, d, "embeddings").groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))).withColumn("weight", F.round("weight", 9))


@query(sql("""SELECT 'review_without_item' AS "check", count(*) AS n FROM review WHERE item_id NOT IN (SELECT item_id FROM item) UNION ALL SELECT 'item_without_category', count(*) FROM item WHERE category_id NOT IN (SELECT category_id FROM category)
    UNION ALL SELECT 'category_code_twice', count(*) FROM (SELECT code FROM category GROUP BY code HAVING count(*) > 1) UNION ALL SELECT 'unsafe_code', count(*) FROM category WHERE NOT regexp_full_match(code, '[A-Z][A-Z0-9_-]{0,31}')
    UNION ALL SELECT 'member_with_two_open', count(*) FROM (SELECT open_member FROM item WHERE open_member IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""))
def invariants(s: SparkSession, d: str) -> DataFrame:
    item, category, review = v.item(s, d), v.category(s, d), v.review(s, d)
    checks = [
        counts.violations("review_without_item", review.join(item, "item_id", "left_anti")), counts.violations("item_without_category", item.join(category, "category_id", "left_anti")),
        counts.violations("category_code_twice", counts.duplicates(category, "code")), counts.violations("unsafe_code", category.filter(~text.is_safe_code(F.col("code")))),
        counts.violations("member_with_two_open", counts.duplicates(item.filter("open_member IS NOT NULL"), "open_member")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


_SOURCES = [f"src{i}" for i in (3, 0, 11, 7, 5, 19, 2, 8)]


@query(f"""WITH r AS (SELECT doc_id AS row, lang AS category, source, list_position({_SOURCES}, source) AS place FROM documents) SELECT category, source, row, CAST(row_number() OVER (PARTITION BY category ORDER BY place, row) AS INTEGER) AS taken_as FROM r WHERE place > 0 QUALIFY taken_as <= 60""")
def quota_fill(s: SparkSession, d: str) -> DataFrame:
    rows = v.table(s, d, "documents").select(F.col("doc_id").alias("row"), F.col("lang").alias("category"), "source")
    return counts.quota_fill(rows, "category", "source", "row", _SOURCES, 60).select("category", "source", "row", "taken_as")


_LICENCES = (
    ("CC BY 4.0", "CC-BY"), ("cc-by-nc", "CC-BY-NC"), ("https://creativecommons.org/licenses/by-sa/4.0/", "CC-BY-SA"), ("http://creativecommons.org/licenses/by-nc-sa/3.0/legalcode", "CC-BY-NC-SA"),
    ("CC0", "CC0"), ("https://creativecommons.org/publicdomain/zero/1.0/", "CC0"), ("Public Domain", "PUBLIC-DOMAIN"), ("licensed under CC BY-ND 4.0", "CC-BY-ND"),
    ("Photo by J. Smith", ""), ("used by permission", ""), ("All rights reserved; attribution required", ""), ("not cc0 licensed", ""), ("", ""),
)


@query("SELECT o_orderkey AS item_id, list_value({})[o_orderkey % {} + 1] AS licence FROM orders".format(", ".join(f"'{want}'" for _, want in _LICENCES), len(_LICENCES)))
def licences(s: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(given) for given, _ in _LICENCES]), (F.col("o_orderkey") % len(_LICENCES) + 1).cast("int"))
    return v.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), urls.licence(said).alias("licence"))


# state transitions: the commands are derived from the review tables


@query(sql("SELECT m.member, i.item_id FROM (SELECT member, row_number() OVER (ORDER BY member) AS n FROM range(9) r(member) WHERE member NOT IN (SELECT open_member FROM item WHERE open_member IS NOT NULL)) m JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM item JOIN category USING (category_id) WHERE item.active AND category.active AND open_member IS NULL AND item_id NOT IN (SELECT item_id FROM current_review)) i USING (n)"))
def pool_assignment(s: SparkSession, d: str) -> DataFrame:
    busy = v.item(s, d).filter("open_member IS NOT NULL").select(F.col("open_member").alias("member"))
    idle = s.range(v.MEMBERS + v.NEW_MEMBERS).withColumnRenamed("id", "member").join(busy, "member", "left_anti")
    return transitions.assign_next(progress.eligible(v.item(s, d), v.category(s, d), v.current_review(s, d)), idle)


_COMMANDS = "commands AS (SELECT review_id AS seq, member, item_id, 'k' || CAST(item_id % 50 AS VARCHAR) AS command_key, decision AS digest FROM review)"
_ANSWERED = "answered AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'APPLIED' WHEN digest = first_value(digest) OVER w THEN 'REPEATED' ELSE 'CONFLICT' END AS first FROM commands WINDOW w AS (PARTITION BY member, command_key ORDER BY seq))"


@query(sql("SELECT seq, CASE WHEN first <> 'APPLIED' THEN first WHEN NOT ok THEN 'NOT_ASSIGNED' WHEN row_number() OVER (PARTITION BY item_id, ok ORDER BY seq) > 1 THEN 'ALREADY_DECIDED' ELSE 'APPLIED' END AS outcome FROM (SELECT a.*, first = 'APPLIED' AND open_member IS NOT DISTINCT FROM member AS ok FROM answered a LEFT JOIN item USING (item_id))", _COMMANDS, _ANSWERED))
def submit_decisions(s: SparkSession, d: str) -> DataFrame:
    commands = v.review(s, d).select(F.col("review_id").alias("seq"), "member", "item_id", F.concat(F.lit("k"), (F.col("item_id") % 50).cast("string")).alias("command_key"), F.col("decision").alias("digest"))
    return transitions.decide(commands, v.item(s, d)).select("seq", "outcome")


@query(sql("SELECT item_id AS key, CASE WHEN item_id % 4 = 1 AND item_id % 3 = 1 THEN 2 ELSE item_id % 3 END AS version, CASE WHEN item_id % 4 = 1 AND item_id % 3 = 1 THEN 'edited' ELSE decision END AS decision, CASE WHEN item_id % 4 <> 1 THEN 'UNCHANGED' WHEN item_id % 3 = 1 THEN 'EDITED' ELSE 'CONFLICT' END AS outcome FROM current_review"))
def edit_reviews(s: SparkSession, d: str) -> DataFrame:
    state = v.current_review(s, d).select(F.col("item_id").alias("key"), (F.col("item_id") % 3).alias("version"), "decision")
    edits = state.filter("key % 4 = 1").select("key", F.lit(1).cast("long").alias("expected"), F.lit("edited").alias("decision"))
    return transitions.edit(state, edits, ["decision"])


@query(sql("SELECT r.item_id, r.member, NOT EXISTS (SELECT 1 FROM review x WHERE x.item_id = r.item_id AND x.member = r.member) AND r.member NOT IN (SELECT open_member FROM item WHERE open_member IS NOT NULL) AS allowed FROM (SELECT item_id, (member + 3) % 9 AS member FROM current_review) r"))
def reopen_targets(s: SparkSession, d: str) -> DataFrame:
    requests = v.current_review(s, d).select("item_id", ((F.col("member") + 3) % (v.MEMBERS + v.NEW_MEMBERS)).alias("member"))
    return transitions.reopen_targets(v.review(s, d), requests, v.item(s, d))


@query(sql("SELECT count(*) AS matched, count(*) FILTER (active) AS disabled, count(open_member) AS released, (SELECT count(*) FROM item WHERE active AND source <> 'BUILDING') AS left_active FROM item WHERE source = 'BUILDING'"))
def bulk_disable(s: SparkSession, d: str) -> DataFrame:
    after, summary = transitions.bulk_disable(v.item(s, d), F.col("source") == "BUILDING")
    return summary.crossJoin(after.agg(F.count_if("active").alias("left_active")))  # one row each


@query(sql("SELECT item_id, CASE WHEN n_regionkey IN (3, 4) THEN 2 ELSE 1 END AS version FROM item JOIN nation ON n_nationkey = category_id"))
def category_toggle(s: SparkSession, d: str) -> DataFrame:
    before = v.category(s, d)
    after = before.withColumn("active", F.col("active") != F.col("sort_order").isin(3, 4))
    return transitions.toggle_category(v.item(s, d).withColumn("version", F.lit(1)), before, after)


@query(sql("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'MACHINERY' ELSE source END AS source, CASE WHEN item_id % 5 = 0 AND source <> 'MACHINERY' THEN 4 ELSE 3 END AS version, item_id % 5 = 0 AND source <> 'MACHINERY' AS changed FROM item"))
def item_patch(s: SparkSession, d: str) -> DataFrame:
    rows = v.item(s, d).select("item_id", "source", F.lit(3).alias("version"))
    return transitions.patch(rows, rows.filter("item_id % 5 = 0").select("item_id", F.lit("MACHINERY").alias("source")), "item_id", ["source"])


@query(sql("SELECT o.item_id, o.version, o.path, CASE WHEN r.item_id IS NULL THEN 'ADDED' WHEN o.path = r.path THEN 'REPEATED' ELSE 'CONFLICT' END AS outcome FROM (SELECT * FROM versioned WHERE NOT succeeded) o LEFT JOIN (SELECT * FROM versioned WHERE succeeded) r USING (item_id, version)", _VERSIONED))
def record_results(s: SparkSession, d: str) -> DataFrame:
    rows = _versioned(s, d)
    return transitions.record(rows.filter("succeeded"), rows.filter("NOT succeeded"), ["item_id", "version"], ["path"])


@query(sql("SELECT r.item_id FROM (SELECT * FROM versioned WHERE succeeded) r LEFT JOIN (SELECT item_id, path, action FROM versioned WHERE succeeded AND item_id % 3 > 0) c USING (item_id) WHERE CASE WHEN r.action = 'REMOVE' THEN c.item_id IS NOT NULL ELSE c.item_id IS NULL OR c.path <> r.path END", _VERSIONED))
def index_consistency(s: SparkSession, d: str) -> DataFrame:
    rows = _versioned(s, d).filter("succeeded")
    return transitions.inconsistent(rows, rows.filter("item_id % 3 > 0").select("item_id", "path"), ["path"])


@query(sql("SELECT review_id AS batch_id, CASE WHEN decision = 'UNSURE' AND created_at + INTERVAL 7 DAY <= TIMESTAMP '1997-06-01' THEN 'expired' WHEN decision = 'UNSURE' THEN 'pending' ELSE 'completed' END AS status FROM review"))
def batch_status(s: SparkSession, d: str) -> DataFrame:
    batches = v.review(s, d).select(F.col("review_id").alias("batch_id"), F.when(F.col("decision") == "UNSURE", "pending").otherwise("completed").alias("status"), (F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return transitions.effective_status(batches, F.lit("1997-06-01").cast("timestamp_ntz")).select("batch_id", "status")
