"""The registered queries of imports, export batches, receipts and summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import hosts, rules
from siltstone.operators import batches, classify, counts, imports, latest, summaries, sync
from siltstone.plans import catalogue as c
from siltstone.plans import views as v
from siltstone.plans.catalogue import query
from siltstone.plans.views import sql

# -- imports ------------------------------------------------------------------------------------------------------

#: Rows of an import file made of documents, so that every check fails somewhere; the same text in either SQL.
_RAW = f"""SELECT doc_id AS row, CASE doc_id % 23 WHEN 0 THEN 'bad code!' WHEN 1 THEN 'A' || chr(1) WHEN 2 THEN repeat('A', 40) WHEN 3 THEN ' ' || upper(lang) || ' ' ELSE upper(lang) END AS seafood_code,
    CASE doc_id % 9 {' '.join(f"WHEN {i} THEN '{s if i % 3 else s.lower()}'" for i, s in enumerate(imports.SOURCES))} ELSE 'FLICKR' END AS source_dataset,
    CASE WHEN doc_id % 29 = 0 THEN '  ' WHEN doc_id % 29 = 1 THEN NULL ELSE ' r' || CAST(doc_id AS STRING) END AS source_record_id,
    CASE doc_id % 31 WHEN 0 THEN '' WHEN 1 THEN 'ftp://x.org/a' WHEN 2 THEN 'http://user@x.org/' WHEN 3 THEN 'https://localhost/a' WHEN 4 THEN 'https://a b.org/' WHEN 5 THEN 'https://x.org/' || chr(127) || 'a' WHEN 6 THEN 'https://x.org?id=1' ELSE 'HTTP://Records.Example.ORG/' || CAST(doc_id AS STRING) END AS source_url,
    CASE WHEN doc_id % 41 = 0 THEN 'https://cdn.Other.net/' || CAST(doc_id AS STRING) || '.jpg' WHEN doc_id % 41 = 1 THEN 'https://images.example.test:8443/1.jpg' WHEN doc_id % 9 IN (2, 3) AND doc_id % 5 > 0 THEN 'https://static.inaturalist.org/photos/' || CAST(doc_id AS STRING) || '/square.JPG?7#f'
        ELSE 'http://images.example.test/' || CAST(doc_id AS STRING) || '.jpg?utm_source=a&b=1' END AS image_url,
    CASE doc_id % 11 WHEN 0 THEN 'all rights reserved' WHEN 1 THEN 'cc_by_4.0' WHEN 2 THEN 'cc-by-nc-sa 3.0' WHEN 3 THEN 'CC-BY-ND' WHEN 4 THEN 'Public-Domain' WHEN 5 THEN 'CC BY' WHEN 6 THEN 'cc0' ELSE ' CC-BY-SA ' END AS license,
    CASE doc_id % 13 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'see the page' WHEN 2 THEN NULL ELSE 'http://creativecommons.org/licenses/by/4.0' END AS license_url,
    CASE doc_id % 17 WHEN 0 THEN 'J' || chr(2) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE ' Jane' || chr(10) || '  Doe ' END AS creator, CASE WHEN doc_id % 7 = 0 THEN 'by hand' ELSE '  ' END AS attribution, '' AS source_location,
    CASE doc_id % 6 WHEN 0 THEN '2020-05-06T10:00' WHEN 1 THEN '3.4.2019' WHEN 2 THEN 'taken 5 June 2018' WHEN 3 THEN 'unknown' WHEN 4 THEN '7 Mar 2017' ELSE '' END AS source_date FROM documents"""
_HOSTS = (".inaturalist.org", "images.example.test")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return s.sql(_RAW.replace("FROM documents", "FROM {docs}"), docs=v.table(s, d, "documents"))


def _address(x: str) -> str:
    host, rest = f"lower(regexp_extract({x}, '^(?i:https?)://([^/?#]*)', 1))", f"regexp_replace({x}, '^(?i:https?)://[^/?#]*', '')"
    fit = rf"regexp_full_match({host}, '([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*(:[0-9]+)?') AND NOT regexp_matches({x}, '\s') AND NOT regexp_matches({host}, '(^|\.)(localhost|invalid)(:|$)')"
    return f"CASE WHEN {fit} THEN 'https://' || {host} || CASE WHEN left({rest}, 1) = '/' THEN '' ELSE '/' END || {rest} END"


_CONTROL = r"'[\x00-\x1F\x7F]'"
_TRIMMED = f"trimmed AS (SELECT row, coalesce(seafood_code, '') AS raw_code, trim(coalesce(seafood_code, '')) AS code, upper(trim(source_dataset)) AS source, trim(coalesce(source_record_id, '')) AS record, trim(source_url) AS su, trim(image_url) AS iu, upper(replace(trim(license), '_', '-')) AS lic, trim(coalesce(license_url, '')) AS lu, trim(regexp_replace(coalesce(creator, ''), '[ \\n\\r\\t]+', ' ', 'g')) AS creator, trim(attribution) AS given, source_date AS said FROM (SELECT * FROM raw_manifest))"
_FORMED = f"formed AS (SELECT *, {_address('su')} AS page, {_address('iu')} AS image, CASE WHEN regexp_matches(lu, '^(?i:https?)://') THEN {_address('lu')} END AS terms FROM trimmed)"
_SIZED = "regexp_matches(image, '^https://[^/?#]*inaturalist[^/?#]*/[^?#]*/(?i:square|small|medium|large|original)\\.[A-Za-z0-9]{1,10}([?#]|$)')"
_SIZE = lambda size: f"regexp_extract(image, '^([^?#]*)/[a-z]+\\.[A-Za-z0-9]+', 1) || '/{size}.' || lower(regexp_extract(image, '^[^?#]*\\.([A-Za-z0-9]+)', 1)) || regexp_extract(image, '^[^?#]*(\\?[^#]*)?', 1)"
_SHOWN = lambda size: f"CASE WHEN source IN ('INATURALIST', 'GBIF') AND {_SIZED} THEN {_SIZE(size)} WHEN source = 'WIKIMEDIA_COMMONS' THEN regexp_replace(image, 'utm_source=a&', '') ELSE image END"
_JUDGED = f"""checked AS (SELECT *, {_SHOWN('large')} AS preview, {_SHOWN('original')} AS original, CASE WHEN length(raw_code) > 32 THEN 'FIELD_TOO_LONG' WHEN regexp_matches(raw_code, {_CONTROL}) THEN 'INVALID_CONTROL_CHARACTER' WHEN NOT regexp_full_match(code, '[A-Z][A-Z0-9_-]{{0,31}}') THEN 'INVALID_SPECIES'
    WHEN source NOT IN {imports.SOURCES} THEN 'UNSUPPORTED_SOURCE' WHEN record = '' THEN 'MISSING_SOURCE_IDENTITY' WHEN regexp_matches(su, {_CONTROL}) THEN 'INVALID_CONTROL_CHARACTER' WHEN su = '' THEN 'MISSING_URL' WHEN page IS NULL OR image IS NULL THEN 'UNSAFE_URL'
    WHEN regexp_matches(lu, '^https?://') AND terms IS NULL THEN 'INVALID_LICENSE_URL' WHEN source = 'INATURALIST' AND NOT {_SIZED} THEN 'UNSAFE_URL' WHEN contains(image, ':8443') THEN 'UNSAFE_URL' WHEN contains(image, 'cdn.other.net') THEN 'UNAPPROVED_IMAGE_HOST'
    WHEN regexp_matches(creator, {_CONTROL}) THEN 'INVALID_CONTROL_CHARACTER' WHEN NOT regexp_full_match(lic, '(CC-BY|CC-BY-NC|CC-BY-NC-SA|CC-BY-SA|CC0|PUBLIC-DOMAIN)([- ][0-9]+(\\.[0-9]+)?)?') THEN 'INVALID_LICENSE' END AS problem FROM formed)"""
_NORMAL = (f"raw_manifest AS ({_RAW})", _TRIMMED, _FORMED, _JUDGED)


@query(sql("""SELECT row, problem, CASE WHEN problem = 'UNAPPROVED_IMAGE_HOST' THEN 'cdn.other.net' END AS host, CASE WHEN problem IS NULL THEN source || '/' || record END AS identity, CASE WHEN problem IS NULL THEN preview END AS preview_url, CASE WHEN problem IS NULL THEN original END AS original_url,
    CASE WHEN problem IS NULL THEN page END AS source_url, CASE WHEN problem IS NULL THEN replace(lic, ' ', '-') END AS license, CASE WHEN problem IS NULL THEN terms END AS license_url, CASE WHEN problem IS NULL THEN coalesce(nullif(given, ''), nullif(creator, ''), source || ' ' || record) END AS attribution,
    CASE WHEN problem IS NULL THEN CASE row % 6 WHEN 0 THEN DATE '2020-05-06' WHEN 1 THEN DATE '2019-04-03' WHEN 2 THEN DATE '2018-06-05' WHEN 4 THEN DATE '2017-03-07' END END AS observed_on, CASE WHEN problem IS NULL AND said = 'unknown' THEN 'UNPARSED_SOURCE_DATE' END AS warning,
    CASE WHEN problem IS NULL THEN concat_ws(',', CASE WHEN su <> page THEN 'source_url' END, CASE WHEN iu NOT IN (preview, original) THEN 'image_url' END, CASE WHEN lu <> terms THEN 'license_url' END) END AS raw_keys FROM checked""", *_NORMAL))
def import_normalize(s: SparkSession, d: str) -> DataFrame:
    rows = imports.normalise(_raw(s, d), _HOSTS)
    identity = F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", "record_id"))
    return rows.select("row", "problem", "host", identity.alias("identity"), "preview_url", "original_url", "source_url", "license", "license_url", "attribution", "observed_on", "warning", F.array_join(F.map_keys("raw_urls"), ",").alias("raw_keys"))


@query(sql("SELECT problem, count(*) AS n, min(row) AS first_row FROM checked WHERE problem IS NOT NULL GROUP BY problem", *_NORMAL))
def import_problems(s: SparkSession, d: str) -> DataFrame:
    rows = imports.normalise(_raw(s, d), _HOSTS).filter("problem IS NOT NULL")
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))


@query("SELECT * FROM (VALUES ('cdn.other.net', 'APPROVED'), ('images.example.test', 'ALREADY_APPROVED'), ('never.seen.org', 'NOT_IN_PREVIEW')) AS t(host, outcome)")
def approve_hosts(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([("CDN.other.net.",), ("images.example.test",), ("never.seen.org",), ("cdn.other.net",)], "host string")
    return imports.approve_hosts(asked, imports.normalise(_raw(s, d), _HOSTS), s.createDataFrame([("images.example.test",)], "host string"))


def _previewed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = v.manifest(s, d)
    stored = latest.first_wins(m.filter("earlier"), ["identity"], "row")
    classified = c._classified(s, d)
    return classified, stored, imports.preview(classified, stored, classify.BLOCKING)


_COUNTED = "counted AS (SELECT count(*) AS total, count(*) FILTER (outcome = 'NEW') AS new, count(*) FILTER (outcome = 'EXACT_DUPLICATE') AS exact, count(*) FILTER (outcome = 'DUPLICATE_IMAGE_URL') AS same_url, count(*) FILTER (outcome IN ('INVALID_SPECIES', 'CONFLICTING_SOURCE_IDENTITY', 'CONFLICTING_IMAGE_SPECIES')) AS blocked FROM classified)"


@query(sql("SELECT CASE WHEN new > 0 THEN 'COMMITTED' ELSE 'IMPORT_NO_VALID_ROWS' END AS status, total, new AS inserted, CASE WHEN new > 0 THEN exact ELSE 0 END AS skipped_exact, CASE WHEN new > 0 THEN same_url ELSE 0 END AS skipped_url_duplicates, CASE WHEN new > 0 THEN blocked ELSE 0 END AS skipped_blocking FROM counted", *c._IMPORT, _COUNTED))
def import_commit(s: SparkSession, d: str) -> DataFrame:
    _, _, said = _previewed(s, d)
    return imports.commit(said, said, skip_blocking=True)


@query(sql("SELECT 'IMPORT_PREVIEW_BLOCKED' AS status, total, 0 AS inserted, 0 AS skipped_exact, 0 AS skipped_url_duplicates, 0 AS skipped_blocking FROM counted WHERE blocked > 0", *c._IMPORT, _COUNTED))
def import_commit_blocked(s: SparkSession, d: str) -> DataFrame:
    _, _, said = _previewed(s, d)
    return imports.commit(said, said)


@query(sql("SELECT row, identity, material, 1 AS version, TRUE AS active FROM manifest WHERE NOT earlier AND row IN (SELECT row FROM classified WHERE outcome = 'NEW') AND identity NOT IN (SELECT identity FROM old)", *c._IMPORT))
def import_inserted(s: SparkSession, d: str) -> DataFrame:
    classified, stored, said = _previewed(s, d)
    rows = v.manifest(s, d).filter("NOT earlier").select("row", "identity", "material")
    return imports.inserted(rows, classified, imports.commit(said, said, skip_blocking=True), stored)


# -- export batches -----------------------------------------------------------------------------------------------

_W = """w AS (SELECT item_id, w.code, w.desired, w.review_id, (SELECT max(review_id) FROM review r WHERE r.item_id = w.item_id) AS latest_review_id, item_id % 4 AS version, md5(record_id) AS metadata, CASE WHEN item_id % 11 = 0 THEN 'new' ELSE 'same' END AS original, CASE WHEN item_id % 2 = 0 THEN '.jpg' ELSE '.image' END AS suffix FROM wanted w JOIN item USING (item_id))"""
_L = """l AS (SELECT item_id, action, CASE WHEN line = 1 THEN 'N000' ELSE code END AS local_code, CASE WHEN part % 2 = 0 THEN current_review.review_id ELSE l.review_id END AS review_id, CASE WHEN part % 5 = 0 THEN 9 ELSE item_id % 4 END AS version, CASE WHEN part % 7 = 0 THEN 'old' ELSE md5(record_id) END AS metadata, 'same' AS original,
    'images/' || CASE WHEN line = 1 THEN 'N000' ELSE code END || '/' || item_id || CASE WHEN part % 3 = 0 THEN '.PNG' WHEN part % 3 = 1 THEN '.tif' ELSE '.image' END AS path FROM latest_local l JOIN item USING (item_id) JOIN category USING (category_id) LEFT JOIN current_review USING (item_id))"""
_D = """d AS (SELECT item_id, CASE WHEN action = 'REMOVE' THEN coalesce(review_id, latest_review_id, local_review) ELSE review_id END AS review_id, code, local_code, action, CASE WHEN action = 'REMOVE' THEN '_removed/b1/' || item_id || CASE WHEN path LIKE '%.PNG' THEN '.png' WHEN path LIKE '%.image' THEN '.image' ELSE suffix END
    WHEN present AND original = 'same' THEN kept ELSE 'images/' || code || '/' || item_id || suffix END AS target, CASE WHEN action IN ('MOVE', 'REMOVE') OR (present AND original = 'new') THEN path END AS previous FROM (
    SELECT *, CASE WHEN desired AND NOT present THEN 'ADD' WHEN desired AND original = 'same' AND kept <> path THEN CASE WHEN local_code <> code THEN 'MOVE' ELSE 'ADD' END WHEN desired AND (review_id IS DISTINCT FROM local_review OR version <> local_version OR metadata <> local_metadata OR original = 'new') THEN 'ADD' WHEN NOT desired AND present THEN 'REMOVE' END AS action
    FROM (SELECT w.*, l.local_code, l.review_id AS local_review, l.version AS local_version, l.metadata AS local_metadata, l.path, coalesce(l.action <> 'REMOVE', FALSE) AS present, 'images/' || w.code || '/' || split_part(l.path, '/', 3) AS kept FROM w LEFT JOIN l USING (item_id))) WHERE action IS NOT NULL)"""
_SCOPED = (c._LATEST_LOCAL, c._WANTED, _W, _L, _D)


def _deltas(s: SparkSession, d: str, scope: str | None = None) -> DataFrame:
    item = v.item(s, d).select("item_id", "record_id", "category_id").join(v.category(s, d).select("category_id", F.col("code").alias("_code")), "category_id")
    newest = v.review(s, d).groupBy("item_id").agg(F.max("review_id").alias("latest_review_id"))
    i, part = F.col("item_id"), F.col("part")
    wanted = c._wanted(s, d).join(item, "item_id").join(newest, "item_id", "left").select(
        "item_id", "code", "desired", "review_id", "latest_review_id", (i % 4).alias("version"), F.md5("record_id").alias("metadata"),
        F.when(i % 11 == 0, "new").otherwise("same").alias("original"), F.when(i % 2 == 0, ".jpg").otherwise(".image").alias("suffix"),
    )
    current = v.current_review(s, d).select("item_id", F.col("review_id").alias("_current"))
    local_code = F.when(F.col("line") == 1, "N000").otherwise(F.col("_code"))
    local = sync.latest_local(v.local_item(s, d)).join(item, "item_id").join(current, "item_id", "left").select(
        "item_id", "action", local_code.alias("local_code"), F.when(part % 2 == 0, F.col("_current")).otherwise(F.col("review_id")).alias("review_id"), F.when(part % 5 == 0, 9).otherwise(i % 4).alias("version"),
        F.when(part % 7 == 0, "old").otherwise(F.md5("record_id")).alias("metadata"), F.lit("same").alias("original"),
        F.concat(F.lit("images/"), local_code, F.lit("/"), i.cast("string"), F.when(part % 3 == 0, ".PNG").when(part % 3 == 1, ".tif").otherwise(".image")).alias("path"),
    )
    return batches.scoped_deltas(wanted, local, "b1", scope)


@query(sql("SELECT item_id, review_id, code, action, target, previous FROM d WHERE review_id IS NOT NULL", *_SCOPED))
def derive_deltas_full(s: SparkSession, d: str) -> DataFrame:
    return _deltas(s, d)


@query(sql("SELECT item_id, review_id, code, action, target, previous FROM d WHERE review_id IS NOT NULL AND (code = 'N000' OR local_code = 'N000')", *_SCOPED))
def derive_deltas_scoped(s: SparkSession, d: str) -> DataFrame:
    return _deltas(s, d, "N000")


NOW = "1998-06-01"
_BATCHES = f"""batch AS (SELECT o_orderkey AS batch_id, 'ALL' AS scope, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END AS status, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 7 DAY AS expires_at, o_orderpriority = '1-URGENT' AS archived FROM orders),
    batch_item AS (SELECT o_orderkey AS batch_id, o_custkey AS item_id, CASE WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'pending' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LIVE = f"live AS (SELECT DISTINCT item_id FROM batch JOIN batch_item USING (batch_id) WHERE batch.status = 'pending' AND batch_item.status = 'pending' AND expires_at > TIMESTAMP '{NOW}')"
_CHUNK = "chunk AS (SELECT item_id, action, target, bytes, CAST(sum(bytes) OVER (ORDER BY CAST(item_id AS VARCHAR), action) AS BIGINT) AS running_bytes FROM (SELECT item_id, action, target, strlen(target) + 100 AS bytes FROM d WHERE review_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM live) ORDER BY CAST(item_id AS VARCHAR), action LIMIT 500))"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = v.table(s, d, "orders"), v.table(s, d, "lineitem")
    made = orders.select(
        F.col("o_orderkey").alias("batch_id"), F.lit("ALL").alias("scope"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), (F.col("o_orderpriority") == "1-URGENT").alias("archived"),
    )
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("item_id"), F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("pending").alias("status"))
    return made, held


def _created(s: SparkSession, d: str, scope: str) -> tuple[DataFrame, DataFrame]:
    return batches.create(_deltas(s, d), *_batches(s, d), scope, _now(), F.octet_length("target") + 100, most_rows=500, most_bytes=40_000)


@query(sql("SELECT item_id, action, target, bytes, running_bytes FROM chunk WHERE running_bytes <= 40000", *_SCOPED, _BATCHES, _LIVE, _CHUNK))
def create_batch(s: SparkSession, d: str) -> DataFrame:
    return _created(s, d, "ALL")[1].select("item_id", "action", "target", "bytes", "running_bytes")


@query(sql(f"SELECT CASE WHEN n = 0 THEN 'NO_WORK' ELSE 'CREATED' END AS status, n AS n_items, CASE WHEN n > 0 THEN TIMESTAMP '{NOW}' + INTERVAL 7 DAY END AS expires_at FROM (SELECT count(*) AS n FROM chunk WHERE running_bytes <= 40000)", *_SCOPED, _BATCHES, _LIVE, _CHUNK))
def create_batch_result(s: SparkSession, d: str) -> DataFrame:
    return _created(s, d, "ALL")[0]


@query(sql("SELECT 'EXPORT_SCOPE_OVERLAP' AS status, 0 AS n_items, CAST(NULL AS TIMESTAMP) AS expires_at WHERE EXISTS (SELECT 1 FROM d JOIN live USING (item_id) WHERE review_id IS NOT NULL)", *_SCOPED, _BATCHES, _LIVE))
def create_batch_overlap(s: SparkSession, d: str) -> DataFrame:
    return _created(s, d, "N003")[0]


@query(sql(f"SELECT batch_id, CASE WHEN status = 'pending' AND (expires_at <= TIMESTAMP '{NOW}' OR (batch_id % 10 = 3 AND NOT archived)) THEN 'expired' ELSE status END AS status, archived OR batch_id % 10 = 3 AS archived FROM batch", _BATCHES))
def expire_archive(s: SparkSession, d: str) -> DataFrame:
    made, _ = _batches(s, d)
    return batches.archive(batches.expire(made, _now()), F.col("batch_id") % 10 == 3).select("batch_id", "status", "archived")


# -- receipts -----------------------------------------------------------------------------------------------------

_SENT = "sent AS (SELECT l_orderkey AS a, l_linenumber AS b, CASE WHEN l_returnflag = 'R' THEN 'REMOVE' ELSE 'ADD' END AS action, CASE WHEN l_linestatus = 'F' THEN 'SUCCEEDED' ELSE 'PENDING' END AS status, CASE WHEN l_linestatus = 'F' THEN sha256(CAST(l_partkey AS VARCHAR)) END AS sha256, 'images/N/' || l_orderkey || '-' || l_linenumber || '.image' AS target, CASE WHEN l_linestatus = 'F' THEN 'images/N/' || l_orderkey || '-' || l_linenumber || CASE WHEN l_returnflag = 'R' THEN '.image' ELSE '.jpg' END END AS path, l_partkey AS part FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey) = 1)"
_BACK = """back AS (SELECT a, CASE WHEN part % 13 = 0 THEN b + 100 ELSE b END AS b, CASE WHEN part % 4 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN part % 17 = 0 THEN 'xyz' WHEN part % 19 = 0 THEN upper(sha256('other')) ELSE upper(sha256(CAST(part AS VARCHAR))) END AS sha256,
    CASE WHEN part % 23 = 0 THEN '../' || target WHEN part % 3 = 0 THEN target ELSE replace(target, '.image', '.jpg') END AS path, action, status AS was, sha256 AS had, path AS lay, target FROM sent WHERE a % 2 = 0)"""
_REJECTED = """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN b > 100 THEN 'RECEIPT_ITEM_NOT_IN_BATCH' WHEN status = 'SUCCEEDED' AND sha256 = 'xyz' THEN 'RECEIPT_HASH_INVALID' WHEN status = 'SUCCEEDED' AND (path LIKE '../%' OR (action = 'REMOVE' AND path <> target)) THEN 'RECEIPT_PATH_INVALID'
    WHEN was = 'SUCCEEDED' AND (status = 'FAILED' OR lower(sha256) <> had OR path <> lay) THEN 'RECEIPT_SUCCESS_CONFLICT' END AS problem FROM back) WHERE problem IS NOT NULL GROUP BY problem"""


def _exchange(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = lambda x: F.col(x).cast("string")
    # few lines are repeated: they are dealt out before they are sorted, so no task sorts what it scans
    keys = ["l_orderkey", "l_linenumber"]
    lines = latest.first_by(v.table(s, d, "lineitem").repartition(*keys), keys, [F.col("l_shipdate"), F.col("l_partkey")])
    done = F.col("l_linestatus") == "F"
    name = F.concat(F.lit("images/N/"), n("l_orderkey"), F.lit("-"), n("l_linenumber"))
    sent = lines.select(
        F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.when(F.col("l_returnflag") == "R", "REMOVE").otherwise("ADD").alias("action"), F.when(done, "SUCCEEDED").otherwise("PENDING").alias("status"),
        F.when(done, F.sha2(n("l_partkey"), 256)).alias("sha256"), F.concat(name, F.lit(".image")).alias("target"), F.when(done, F.concat(name, F.when(F.col("l_returnflag") == "R", ".image").otherwise(".jpg"))).alias("path"), F.lit(None).cast("string").alias("error"), F.col("l_partkey").alias("part"),
    )
    part, target = F.col("part"), F.col("target")
    back = sent.filter(F.col("a") % 2 == 0).select(
        "a", F.when(part % 13 == 0, F.col("b") + 100).otherwise(F.col("b")).alias("b"), F.when(part % 4 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(part % 17 == 0, "xyz").when(part % 19 == 0, F.upper(F.sha2(F.lit("other"), 256))).otherwise(F.upper(F.sha2(n("part"), 256))).alias("sha256"),
        F.when(part % 23 == 0, F.concat(F.lit("../"), target)).when(part % 3 == 0, target).otherwise(F.replace(target, F.lit(".image"), F.lit(".jpg"))).alias("path"),
    )
    return sent, back


@query(sql(_REJECTED, _SENT, _BACK))
def receipt_rejections(s: SparkSession, d: str) -> DataFrame:
    sent, back = _exchange(s, d)
    return batches.receipt_rejections(sent, back, ["a", "b"])


_GOOD = "good AS (SELECT a, b, CASE WHEN part % 4 = 0 AND status <> 'SUCCEEDED' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, coalesce(sha256, sha256(CAST(part AS VARCHAR))) AS sha256 FROM sent WHERE a % 2 = 0)"


def _applied(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sent, _ = _exchange(s, d)
    ok = (F.col("status") == "SUCCEEDED") | (F.col("part") % 4 != 0)
    good = sent.filter(F.col("a") % 2 == 0).select(
        "a", "b", F.when(ok, "SUCCEEDED").otherwise("FAILED").alias("status"), F.coalesce("sha256", F.sha2(F.col("part").cast("string"), 256)).alias("sha256"), F.coalesce("path", "target").alias("path")
    )
    good = batches.accepted(good, batches.receipt_rejections(sent, good, ["a", "b"]))
    return sync.apply_receipt(sent, good, ["a", "b"]), good


@query(sql("""SELECT a, CASE WHEN n_pending > 0 THEN 'pending' ELSE 'completed' END AS status, n_accepted, n_pending FROM (SELECT s.a, count(*) FILTER (g.status = 'SUCCEEDED') AS n_accepted, count(*) FILTER (s.status <> 'SUCCEEDED' AND g.status IS DISTINCT FROM 'SUCCEEDED') AS n_pending FROM sent s LEFT JOIN good g USING (a, b) GROUP BY s.a)""", _SENT, _GOOD))
def receipt_state(s: SparkSession, d: str) -> DataFrame:
    after, good = _applied(s, d)
    return batches.receipt_state(after, good, ["a"], ["a", "b"])


@query(sql("SELECT a, b, 'accepted' AS list FROM good WHERE status = 'SUCCEEDED' UNION ALL SELECT s.a, s.b, 'pending' FROM sent s LEFT JOIN good g USING (a, b) WHERE s.status <> 'SUCCEEDED' AND g.status IS DISTINCT FROM 'SUCCEEDED'", _SENT, _GOOD))
def receipt_lists(s: SparkSession, d: str) -> DataFrame:
    after, good = _applied(s, d)
    return batches.receipt_lists(after, good, ["a", "b"])


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN r.position IS NULL THEN 'COUNT_MISMATCH' WHEN m.position IS NULL OR m.item <> r.item THEN 'ITEM_MISMATCH' END AS problem FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + 1000000 * o_custkey AS position, o_orderkey AS item FROM orders) m
    FULL JOIN (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + 1000000 * o_custkey AS position, o_orderkey AS item FROM orders WHERE o_orderkey % 50 > 0) r ON m.position = r.position) WHERE problem IS NOT NULL GROUP BY problem""")
def receipt_positions(s: SparkSession, d: str) -> DataFrame:
    def placed(df: DataFrame) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        return df.select((n - 1 + 1_000_000 * F.col("o_custkey")).alias("position"), F.col("o_orderkey").alias("item"))

    orders = v.table(s, d, "orders").select("o_custkey", "o_orderkey")
    return batches.receipt_against_manifest(placed(orders.filter("o_orderkey % 50 > 0")), placed(orders), ["item"], cancelled=False)


@query(sql("SELECT 'ACCEPTED_NOT_SUCCEEDED' AS problem, (SELECT count(DISTINCT item_id) FROM review WHERE decision = 'APPROVED' AND item_id NOT IN (SELECT item_id FROM latest_local)) AS n UNION ALL SELECT 'PENDING_NOT_IN_MANIFEST', (SELECT count(DISTINCT item_id) FROM review WHERE decision = 'REJECTED' AND item_id NOT IN (SELECT item_id FROM item WHERE active)) UNION ALL SELECT 'IN_BOTH', (SELECT count(*) FROM (SELECT item_id FROM review WHERE decision = 'APPROVED' INTERSECT SELECT item_id FROM review WHERE decision = 'REJECTED'))", c._LATEST_LOCAL))
def receipt_list_problems(s: SparkSession, d: str) -> DataFrame:
    r = v.review(s, d)
    return batches.list_problems(v.item(s, d).filter("active"), sync.latest_local(v.local_item(s, d)), r.filter("decision = 'APPROVED'"), r.filter("decision = 'REJECTED'"), "item_id")


# -- summaries ----------------------------------------------------------------------------------------------------


@query(sql("SELECT item_id, code, name, decision, member, CASE WHEN review_id IS NOT NULL THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') END AS created_at FROM item JOIN category USING (category_id) LEFT JOIN current_review USING (item_id)"))
def item_summaries(s: SparkSession, d: str) -> DataFrame:
    rows = summaries.item_summaries(v.item(s, d), v.category(s, d), v.current_review(s, d))
    return rows.select("item_id", "category.code", "category.name", "review.decision", "review.member", "review.created_at")


@query(sql("""SELECT review_id, '{"review_id":' || review_id || ',"decision":"' || decision || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS snapshot FROM review"""))
def review_snapshots(s: SparkSession, d: str) -> DataFrame:
    return v.review(s, d).select("review_id", summaries.snapshot(["review_id", "decision", "created_at"], ["created_at"]).alias("snapshot"))


@query(sql("SELECT item_id, record_id, (SELECT count(*) FROM item WHERE active) AS total FROM item WHERE active ORDER BY record_id, item_id LIMIT 40 OFFSET 7"))
def item_page_total(s: SparkSession, d: str) -> DataFrame:
    return summaries.page_with_total(v.item(s, d).filter("active").select("item_id", "record_id"), [F.col("record_id"), F.col("item_id")], 40, 7)


@query(sql("SELECT action, coalesce(n, 0) AS n FROM (VALUES ('ADD'), ('MOVE'), ('REMOVE'), ('SKIP')) AS k(action) LEFT JOIN (SELECT action, count(*) AS n FROM local_item GROUP BY action) USING (action) UNION ALL SELECT 'TOTAL', count(*) FROM local_item"))
def action_counts(s: SparkSession, d: str) -> DataFrame:
    return summaries.kind_counts(v.local_item(s, d), "action", ["ADD", "MOVE", "REMOVE", "SKIP"])


@query(sql("SELECT code, source, count(*) AS n FROM item JOIN category USING (category_id) GROUP BY code, source"))
def existing_source_counts(s: SparkSession, d: str) -> DataFrame:
    return v.item(s, d).join(v.category(s, d).select("category_id", "code"), "category_id").groupBy("code", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) AS total FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY split")
def split_counts(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 10
    docs = v.table(s, d, "documents").select("lang", F.when(n < 8, "train").when(n == 8, "val").otherwise("test").alias("split"))
    return summaries.split_counts(docs, "split", "lang", ["en", "de", "fr"])


@query("""SELECT row_number() OVER (ORDER BY l, p) AS place, host FROM (SELECT host, l, p FROM (SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS l, page_id AS p FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY l, p) = 1)""")
def allowlist_union(s: SparkSession, d: str) -> DataFrame:
    pages = v.table(s, d, "pages").select(F.col("page_id").alias("position"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return summaries.ordered_union(pages.filter("position % 2 = 0"), pages.filter("position % 2 = 1"))


_ASKED = f"asked AS (SELECT item_id, CASE WHEN item_id % 14 = 0 THEN 2 ELSE 1 END AS expected, CASE WHEN item_id % 3 > 0 THEN {v.MEMBERS} + item_id % 4 END AS member FROM item WHERE item_id % 7 < 2)"
_PASSED = f"""judged_request AS (SELECT a.item_id, a.member, i.open_member, CASE WHEN expected <> 1 THEN 'STALE_CANDIDATE_VERSION' WHEN open_member IS NULL THEN 'CANDIDATE_NOT_OPEN' WHEN a.member IS NOT NULL AND NOT active THEN 'SPECIES_NOT_ACTIVE'
    WHEN a.item_id IN (SELECT item_id FROM current_review) THEN 'CANDIDATE_ALREADY_REVIEWED' WHEN a.member = {v.MEMBERS + 3} THEN 'REVIEWER_NOT_ELIGIBLE' END AS problem FROM asked a JOIN item i USING (item_id))"""


@query(sql("""SELECT item_id, CASE WHEN outcome IN ('TRANSFERRED', 'RELEASED') THEN member ELSE open_member END AS open_member, CASE WHEN outcome IN ('TRANSFERRED', 'RELEASED') THEN 2 ELSE 1 END AS version, outcome FROM (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN member IS NULL THEN 'RELEASED'
    WHEN item_id > min(item_id) FILTER (problem IS NULL) OVER (PARTITION BY member) THEN 'REVIEWER_NOT_ELIGIBLE' ELSE 'TRANSFERRED' END AS outcome FROM judged_request)""", _ASKED, _PASSED))
def pass_on_items(s: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    item = v.item(s, d)
    asked = item.filter(i % 7 < 2).select("item_id", F.when(i % 14 == 0, 2).otherwise(1).alias("version"), F.when(i % 3 > 0, v.MEMBERS + i % 4).alias("member"))
    current = v.current_review(s, d).select("review_id", F.lit(True).alias("current"))
    reviewed = v.review(s, d).join(current, "review_id", "left").select("item_id", "member", F.coalesce("current", F.lit(False)).alias("current"))
    members = s.range(v.MEMBERS, v.MEMBERS + 4).select(F.col("id").alias("member"), (F.col("id") != v.MEMBERS + 3).alias("active"))
    return summaries.pass_on(item.select("item_id", F.lit(1).alias("version"), "active", "open_member"), asked, reviewed, members)


@query(sql("SELECT review_id, item_id, coalesce(CASE WHEN review_id % 3 = 0 THEN 'known' END, record_id) AS record_id FROM review LEFT JOIN item USING (item_id)"))
def snapshot_backfill(s: SparkSession, d: str) -> DataFrame:
    rows = v.review(s, d).select("review_id", "item_id", F.when(F.col("review_id") % 3 == 0, "known").alias("record_id"))
    return summaries.filled(rows, v.item(s, d), "item_id", ["record_id"])


# -- scalar rules -------------------------------------------------------------------------------------------------

_AT = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'wikimedia' WHEN 1 THEN 'inaturalist' WHEN 2 THEN 'host:' || {_AT} ELSE 'fish-vista' END AS bucket,
    CAST(CASE WHEN page_id % 4 = 0 THEN 6.5 ELSE 1 END AS DOUBLE) AS seconds, '["' || list_aggregate(list_sort([{_AT}, CASE page_id % 4 WHEN 0 THEN 'upload.wikimedia.org' WHEN 1 THEN 'inaturalist.org' WHEN 2 THEN 'notinaturalist.org' ELSE 'a.fishair.org' END]), 'string_agg', '","') || '"]' AS hosts FROM pages WHERE regexp_matches(url, '^https?://')""")
def source_buckets(s: SparkSession, d: str) -> DataFrame:
    pages = v.table(s, d, "pages").filter("url RLIKE '^https?://'")
    n = F.col("page_id") % 4
    other = F.when(n == 0, "https://upload.wikimedia.org/a").when(n == 1, "https://INaturalist.org./b").when(n == 2, "https://notinaturalist.org/").otherwise("https://a.fishair.org:443/c")
    return pages.select("page_id", F.col("url"), other.alias("other")).select("page_id", rules.source_bucket(F.col("url"), F.col("other")).alias("_b"), rules.used_hosts(F.col("url"), F.col("other")).alias("hosts")).select("page_id", "_b.bucket", "_b.seconds", "hosts")


@query("SELECT doc_id, substr(CASE WHEN regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'x' ELSE regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') END, 1, 128) AS part FROM documents")
def path_parts(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "documents").select("doc_id", rules.path_part(F.col("text"), "x").alias("part"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'NETWORK_ERROR' ELSE 'DOWNLOAD_ERROR' END WHEN 'N' THEN CASE l_linestatus WHEN 'F' THEN 'FILESYSTEM_ERROR' ELSE 'OPERATION_ERROR' END ELSE CASE l_linestatus WHEN 'F' THEN 'INDEX_ERROR' ELSE 'SETUP_ERROR' END END AS category FROM lineitem")
def error_categories(s: SparkSession, d: str) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    stage = F.when(F.col("l_returnflag") == "A", "download").otherwise("operation")
    code = F.when(F.col("l_returnflag") == "A", F.when(done, "NETWORK_ERROR").otherwise("TIMED_OUT")).when(F.col("l_returnflag") == "N", F.when(done, "PATH_UNSAFE").otherwise("NEVER_HEARD_OF")).otherwise(F.when(done, "INDEX_READ_FAILED").otherwise("LOG_SETUP_FAILED"))
    return v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.error_category(stage, code).alias("category"))


# -- hosts ------------------------------------------------------------------------------------------------------------

_HOSTED = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://10.' || CAST(page_id % 256 AS STRING) || '.0.1/' WHEN 1 THEN 'https://8.8.' || CAST(page_id % 256 AS STRING) || '.' || CAST(page_id % 300 AS STRING) || ':8080/x' WHEN 2 THEN 'http://bücher.example/' || CAST(page_id AS STRING) WHEN 3 THEN 'https://[2001:4860::' || CAST(page_id % 10000 AS STRING) || ']?q'
    WHEN 4 THEN 'https://[fe80::' || CAST(page_id % 10000 AS STRING) || ']/' WHEN 5 THEN 'https://172.' || CAST(page_id % 64 AS STRING) || '.1.1/' WHEN 6 THEN 'https://例え.テスト#' || CAST(page_id AS STRING) WHEN 7 THEN url ELSE 'HTTPS://Host' || CAST(page_id AS STRING) || '.ORG' END AS url FROM pages"""


@query(f"""WITH hosted AS ({_HOSTED}) SELECT page_id, url, CASE page_id % 9 WHEN 1 THEN url WHEN 2 THEN 'https://xn--bcher-kva.example/' || page_id WHEN 3 THEN replace(url, '?', '/?') WHEN 5 THEN CASE WHEN page_id % 64 NOT BETWEEN 16 AND 31 THEN url END WHEN 6 THEN 'https://xn--r8jz45g.xn--zckzah/#' || page_id WHEN 8 THEN 'https://host' || page_id || '.org/'
    WHEN 7 THEN CASE WHEN regexp_full_match(url, 'https?://([a-z0-9-]+[.])+[a-z]+(/.*)?') AND NOT regexp_matches(url, '\\s') THEN regexp_replace(regexp_replace(url, '^https?', 'https'), '^(https://[^/]*)$', '\\1/') END END AS normalized FROM hosted""")
def url_hosts(s: SparkSession, d: str) -> DataFrame:
    """URLs of every page, most with hosts that are addresses or not ASCII, in one form or null."""
    rows = s.sql(_HOSTED.replace("FROM pages", "FROM {pages}"), pages=v.table(s, d, "pages"))
    return rows.select("page_id", "url", hosts.normalized(F.col("url")).alias("normalized"))


@query(sql("""SELECT code, 'Row rejected: ' || code AS message, TRUE AS blocking, host, count(*) AS n, array_to_string(list_sort(list(row))[1:10], ',') AS sample_rows, greatest(count(*) - 10, 0) AS omitted FROM (SELECT row, problem AS code, CASE WHEN problem = 'UNAPPROVED_IMAGE_HOST' THEN 'cdn.other.net' END AS host FROM checked WHERE problem IS NOT NULL) GROUP BY code, host""", *_NORMAL))
def import_issue_groups(s: SparkSession, d: str) -> DataFrame:
    """Problems of an import's rows by code, message, blocking and host, with the first rows of each."""
    rows = imports.normalise(_raw(s, d), _HOSTS).filter("problem IS NOT NULL")
    issues = rows.select(F.col("problem").alias("code"), F.concat(F.lit("Row rejected: "), F.col("problem")).alias("message"), F.lit(True).alias("blocking"), "host", "row", F.lit(None).cast("long").alias("related_row"))
    groups = counts.issue_groups(issues, group=("code", "message", "blocking", "host"))
    return groups.select("code", "message", "blocking", "host", "n", F.array_join(F.transform("samples", lambda x: x["row"].cast("string")), ",").alias("sample_rows"), "omitted")
