"""The registered queries of versioned rows, decisions, patches, commits and canonical JSON, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import canonical_json
from siltstone.operators import history, transitions
from siltstone.plans import views as v
from siltstone.plans.catalogue import _ANSWERED, _COMMANDS, query
from siltstone.plans.views import sql

# -- canonical JSON ---------------------------------------------------------------------------------------------------


def _json(c: str) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"(?s)^\[(.*)\]$", 1)


_ESCAPED = """array_to_string(list_transform(regexp_extract_all(s, '(?s).'), lambda c: CASE WHEN unicode(c) > 65535 THEN printf('\\u%04x\\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) WHEN unicode(c) > 126 THEN printf('\\u%04x', unicode(c)) ELSE c END), '')"""


@query(f"""WITH said AS (SELECT doc_id, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n, '{{"A":{{}},"lang":' || to_json(coalesce(lang, '')) || ',"n":' || length(coalesce(text, '')) || ',"z":{{"a":[1,{{"c":true,"d":null,"é":"ü\\n"}}],"b":' || to_json(coalesce(text, '')) || '}}}}' AS s FROM documents)
    SELECT doc_id, sha256(s) AS digest, sha256({_ESCAPED}) AS ascii_digest, '{{"content_hash":"[REDACTED]","keep":' || to_json(lang) || ',"user":{{"Password":"[REDACTED]","list":[{{"api_TOKEN":"[REDACTED]","n":' || n || '}},2.5]}}}}' AS redacted FROM said""")
def canonical_digests(s: SparkSession, d: str) -> DataFrame:
    """Digests of nested objects around each document, and a nested object without its secrets."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("string")
    nested = F.concat(F.lit('{"z": {"b": '), _json("text"), F.lit(', "a": [1, {"é": "ü\\n", "d": null, "c": true}]}, "n": '), n, F.lit(' , "lang": '), _json("lang"), F.lit(', "A": {}}'))
    secret = F.concat(F.lit('{"user": {"list": [{"n": '), n, F.lit(', "api_TOKEN": 1}, 2.50], "Password": {"of": '), _json("text"), F.lit('}}, "keep": '), _json("lang"), F.lit(', "content_hash": [1]}'))
    docs = v.table(s, d, "documents").select("doc_id", nested.alias("nested"), secret.alias("secret"))
    return docs.select("doc_id", canonical_json.digest(F.col("nested")).alias("digest"), canonical_json.digest(F.col("nested"), ascii_only=True).alias("ascii_digest"), canonical_json.redacted(F.col("secret")).alias("redacted"))


# -- versions ---------------------------------------------------------------------------------------------------------

_EDITS = "edits AS (SELECT item_id AS key, review_id AS seq, decision, created_at AS at, 1 + review_id % 5 AS expected, row_number() OVER (PARTITION BY item_id ORDER BY review_id) = 1 AS first FROM review)"
_CHAIN = "chain AS (SELECT key, CAST(1 AS BIGINT) AS version, seq FROM edits WHERE first UNION ALL SELECT c.key, c.version + 1, min(e.seq) FROM chain c JOIN edits e ON e.key = c.key AND e.seq > c.seq AND e.expected = c.version GROUP BY c.key, c.version)"
_STATES = "states AS (SELECT c.key, c.version, max(e.at) OVER (PARTITION BY c.key ORDER BY c.version) AS valid_from, e.decision FROM chain c JOIN edits e ON e.key = c.key AND e.seq = c.seq), revised AS (SELECT *, lead(valid_from) OVER w AS valid_to, lag(decision) OVER w AS before FROM states WINDOW w AS (PARTITION BY key ORDER BY version))"
_recursive = lambda q: sql(q, _EDITS, _CHAIN, _STATES).replace("WITH ", "WITH RECURSIVE ", 1)


def _edits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each item's first review as its first state, the others as edits that expect one of five versions."""
    rows = v.review(s, d).select(F.col("item_id").alias("key"), F.col("review_id").alias("seq"), "decision", F.col("created_at").alias("at"), (1 + F.col("review_id") % 5).alias("expected"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("decision", "at", "seq"), "seq").alias("f")).select("key", "f.*")
    return first, history.versioned(rows.join(first.select("key", "seq"), ["key", "seq"], "left_anti"))


def _revised(s: SparkSession, d: str) -> DataFrame:
    first, edits = _edits(s, d)
    states = first.select("key", F.lit(1).cast("long").alias("version"), "at", "decision").unionByName(edits.filter("outcome = 'EDITED'").select("key", "version", "at", "decision"))
    return history.revisions(states, ["decision"])


@query(_recursive("SELECT e.key, e.seq, CASE WHEN c.seq IS NULL THEN 'CONFLICT' ELSE 'EDITED' END AS outcome, (SELECT max(version) FROM chain x WHERE x.key = e.key AND x.seq <= e.seq) AS version FROM edits e LEFT JOIN chain c ON c.key = e.key AND c.seq = e.seq WHERE NOT e.first"))
def edit_chain(s: SparkSession, d: str) -> DataFrame:
    return _edits(s, d)[1].select("key", "seq", "outcome", "version")


@query(_recursive("SELECT key, version, valid_from, valid_to, before, decision FROM revised"))
def review_revisions(s: SparkSession, d: str) -> DataFrame:
    return _revised(s, d).select("key", "version", "valid_from", "valid_to", F.col("before.decision").alias("before"), F.col("after.decision").alias("decision"))


@query(_recursive("""SELECT l_orderkey AS review_id, l_linenumber AS line, r.version, r.decision FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN revised r ON r.key = o_custkey AND r.valid_from <= l_shipdate AND (r.valid_to IS NULL OR r.valid_to > l_shipdate)"""))
def review_as_of(s: SparkSession, d: str) -> DataFrame:
    """The decision on an item at the time of each of its lines."""
    lines = v.local_item(s, d).select(F.col("item_id").alias("key"), F.col("succeeded_at").alias("at"), "review_id", "line")
    return history.as_of(_revised(s, d), lines).select("review_id", "line", "version", F.col("state.decision").alias("decision"))


_DECIDED = "judged AS (SELECT seq, a.item_id, a.member, command_key, digest AS decision, first = 'APPLIED' AND open_member IS NOT DISTINCT FROM member AS ok FROM answered a LEFT JOIN item USING (item_id)), done AS (SELECT * FROM judged WHERE ok QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY seq) = 1)"


@query(sql("SELECT item_id, CASE WHEN done.seq IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN done.seq IS NULL THEN open_member END AS open_member, done.member || '/' || command_key AS review_id, done.member AS reviewer, decision, CASE WHEN done.seq IS NOT NULL THEN CAST(1 AS BIGINT) END AS review_version FROM item LEFT JOIN done USING (item_id)", _COMMANDS, _ANSWERED, _DECIDED))
def decided_items(s: SparkSession, d: str) -> DataFrame:
    """Items after all decisions, with the reviews and revisions that these made."""
    commands = v.review(s, d).select(F.col("review_id").alias("seq"), "member", "item_id", F.concat(F.lit("k"), (F.col("item_id") % 50).cast("string")).alias("command_key"), F.col("decision").alias("digest"), "decision", F.col("created_at").alias("at"))
    _, reviews, revisions, after = history.decided(commands, v.item(s, d).select("item_id", "open_member", F.lit(1).alias("version")))
    told = reviews.join(revisions.select(F.col("key").alias("review_id"), F.col("version").alias("review_version")), "review_id").select("item_id", "review_id", "reviewer", "decision", "review_version")
    return after.join(told, "item_id", "left").select("item_id", "version", "open_member", "review_id", "reviewer", "decision", "review_version")


_CHANGES = """changes AS (SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 7 ELSE 1 END AS expected, item_id % 4 < 3 AS confirm, CASE WHEN item_id % 4 < 2 THEN 5 END AS new_reviewer, CAST(CASE item_id % 5 WHEN 0 THEN 99 WHEN 1 THEN category_id WHEN 4 THEN NULL ELSE (category_id + 3) % 25 END AS BIGINT) AS category_id,
    CASE WHEN item_id % 13 = 0 THEN 'BUILDING' END AS source, CASE WHEN item_id % 17 = 0 THEN 'Customer#' || lpad(CAST(item_id - 1 AS VARCHAR), 9, '0') WHEN item_id % 19 = 0 THEN 'new ' || CAST(item_id % 3 AS VARCHAR) END AS record_id FROM item WHERE item_id % 2 = 0 UNION ALL SELECT -1, 1, FALSE, NULL, 3, NULL, NULL)"""
_PATCH = """joined AS (SELECT c.*, i.item_id IS NOT NULL AS known, i.category_id AS old_category, i.source AS old_source, i.record_id AS old_record, i.active, i.open_member, g.active AS category_active, r.review_id, r.member AS reviewer, r.decision,
        c.category_id IS NOT NULL AND c.category_id IS DISTINCT FROM i.category_id AS moved, c.confirm OR c.new_reviewer IS NOT NULL AS controls, coalesce(c.category_id, i.category_id) AS new_category, coalesce(c.source, i.source) AS new_source, coalesce(c.record_id, i.record_id) AS new_record
        FROM changes c LEFT JOIN item i USING (item_id) LEFT JOIN current_review r ON r.item_id = c.item_id LEFT JOIN category g ON g.category_id = c.category_id),
    checked AS (SELECT *, CASE WHEN NOT known THEN 'NOT_FOUND' WHEN expected <> 1 THEN 'STALE_VERSION' WHEN open_member IS NOT NULL THEN 'CURRENTLY_OPEN' WHEN controls AND NOT moved THEN 'INVALIDATION_REQUIRES_CATEGORY_CHANGE' WHEN moved AND category_active IS NULL THEN 'CATEGORY_NOT_FOUND' WHEN moved AND NOT category_active THEN 'CATEGORY_NOT_ACTIVE'
        WHEN moved AND review_id IS NOT NULL AND NOT active THEN 'ITEM_NOT_ACTIVE' WHEN moved AND review_id IS NOT NULL AND NOT (confirm AND new_reviewer IS NOT NULL) THEN 'CONFIRMATION_REQUIRED' WHEN moved AND review_id IS NULL AND controls THEN 'INVALIDATION_NOT_APPLICABLE'
        WHEN new_category = old_category AND new_source = old_source AND new_record = old_record THEN 'NO_CHANGES' END AS refused FROM joined),
    owners AS (SELECT source, record_id FROM (SELECT item_id, source, record_id FROM item UNION SELECT item_id, new_source, new_record FROM checked WHERE refused IS NULL) GROUP BY source, record_id HAVING count(DISTINCT item_id) > 1),
    patched AS (SELECT *, coalesce(refused, CASE WHEN (new_source <> old_source OR new_record <> old_record) AND (new_source, new_record) IN (SELECT (source, record_id) FROM owners) THEN 'SOURCE_CONFLICT' END, 'PATCHED') AS outcome FROM checked)"""


@query(sql("""SELECT item_id, outcome, CAST(CASE WHEN outcome = 'PATCHED' THEN new_category ELSE old_category END AS BIGINT) AS category_id, CASE WHEN outcome = 'PATCHED' THEN new_source ELSE old_source END AS source, CASE WHEN outcome = 'PATCHED' THEN new_record ELSE old_record END AS record_id,
    CASE WHEN known THEN CASE WHEN outcome = 'PATCHED' THEN 2 ELSE 1 END END AS version, CASE WHEN outcome = 'PATCHED' AND moved AND review_id IS NOT NULL THEN new_reviewer ELSE open_member END AS open_member, CASE WHEN outcome = 'PATCHED' AND moved THEN review_id END AS fallen_review,
    CASE WHEN outcome = 'PATCHED' AND moved AND review_id IS NOT NULL THEN 2 END AS fallen_version FROM patched""", _CHANGES, _PATCH))
def patched_items(s: SparkSession, d: str) -> DataFrame:
    """Changes of every second item, the items after them and the reviews that fell."""
    i, item = F.col("item_id"), v.item(s, d)
    number = F.lpad((i - 1).cast("string"), 9, "0")
    changes = item.filter(i % 2 == 0).select(
        "item_id", F.when(i % 11 == 0, 7).otherwise(1).alias("expected"), (i % 4 < 3).alias("confirm"), F.when(i % 4 < 2, 5).alias("new_reviewer"),
        F.when(i % 5 == 0, 99).when(i % 5 == 1, F.col("category_id")).when(i % 5 != 4, (F.col("category_id") + 3) % 25).cast("long").alias("category_id"), F.when(i % 13 == 0, "BUILDING").alias("source"),
        F.when(i % 17 == 0, F.concat(F.lit("Customer#"), number)).when(i % 19 == 0, F.concat(F.lit("new "), (i % 3).cast("string"))).alias("record_id"),
    )
    changes = changes.unionByName(s.createDataFrame([(-1, 1, False, None, 3, None, None)], changes.schema))
    items = item.select("item_id", "category_id", "source", "record_id", "active", "open_member", F.lit(1).alias("version"))
    reviews = v.current_review(s, d).select("item_id", "review_id", F.col("member").alias("reviewer"), "decision", F.lit(True).alias("is_current"), F.lit(1).alias("version"))
    said, after, fell = history.patched(changes, items, v.category(s, d), reviews, ["category_id", "source", "record_id"])
    fell = fell.select("item_id", F.col("review_id").alias("fallen_review"), F.col("after.version").alias("fallen_version"))
    return said.select("item_id", "outcome").join(after.drop("active"), "item_id", "left").join(fell, "item_id", "left")


# -- commits ----------------------------------------------------------------------------------------------------------

#: An import for each source, language and thousand of documents (files are bounded), staged against the stored documents of the language then; both asked for twice.
_STAGED = """stored AS (SELECT coalesce(lang, '') AS scope, count(*) || ':' || sum(doc_id) AS fingerprint FROM documents WHERE doc_id % 5 = 0 GROUP BY 1),
    staged_against AS (SELECT coalesce(lang, '') AS scope, count(*) || ':' || sum(doc_id) AS expected FROM documents WHERE doc_id % 5 = 0 AND NOT (lang = 'de' AND doc_id % 10 = 0) GROUP BY 1),
    staged AS (SELECT coalesce(lang, '') AS scope, coalesce(source, '') AS source, coalesce(lang, '') || '/' || coalesce(source, '') || '/' || CAST(doc_id // 1000 AS VARCHAR) AS name, min(doc_id) AS least, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 97 <> 0 AND coalesce(source, '') NOT LIKE '%7') AS new, count(*) FILTER (doc_id % 97 = 0) AS blocked, coalesce(source, '') LIKE '%2' AS late, coalesce(source, '') LIKE '%1' AS skip FROM documents GROUP BY ALL),
    requests AS (SELECT s.*, expected, round * 1000000000 + least AS seq FROM staged s LEFT JOIN staged_against USING (scope), (VALUES (0), (1)) AS t(round)),
    fits AS (SELECT q.*, fingerprint, source = 'src3' AS logged, CASE WHEN late THEN 'EXPIRED' WHEN blocked > 0 AND NOT skip THEN 'BLOCKED' WHEN expected IS DISTINCT FROM fingerprint THEN 'STALE' WHEN skip AND new = 0 THEN 'NO_VALID_ROWS' END AS early FROM requests q LEFT JOIN stored USING (scope)),
    turned AS (SELECT *, min(seq) FILTER (NOT logged AND early IS NULL AND new > 0) OVER (PARTITION BY scope) AS change FROM fits),
    went AS (SELECT *, NOT logged AND early IS NULL AND (change IS NULL OR seq <= change) AS goes FROM turned),
    told AS (SELECT *, min(seq) FILTER (goes) OVER (PARTITION BY name) AS done FROM went)"""


@query(f"WITH {_STAGED} SELECT seq, name, outcome, CASE WHEN outcome = 'REPEATED' AND logged THEN 5 WHEN outcome IN ('REPEATED', 'COMMITTED') THEN new ELSE 0 END AS inserted FROM (SELECT *, CASE WHEN logged OR done < seq THEN 'REPEATED' WHEN goes THEN 'COMMITTED' WHEN early = 'NO_VALID_ROWS' AND seq > change THEN 'STALE' ELSE coalesce(early, 'STALE') END AS outcome FROM told)")
def import_commits(s: SparkSession, d: str) -> DataFrame:
    docs = v.table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("scope"), F.coalesce("source", F.lit("")).alias("source"), F.expr("doc_id div 1000").alias("block"))
    i = F.col("doc_id")
    mark = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("doc_id").cast("string"))
    states = docs.filter(i % 5 == 0).groupBy("scope").agg(mark.alias("fingerprint"))
    then = docs.filter((i % 5 == 0) & ~((F.col("scope") == "de") & (i % 10 == 0))).groupBy("scope").agg(mark.alias("expected"))
    staged = docs.groupBy("scope", "source", "block").agg(F.min("doc_id").alias("least"), F.count_if((i % 5 != 0) & (i % 97 != 0) & ~F.col("source").endswith("7")).alias("new"), F.count_if(i % 97 == 0).alias("blocked"))
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    expires = F.when(F.col("source").endswith("2"), F.lit("2024-01-10")).otherwise("2024-01-11").cast("timestamp_ntz")
    staged = staged.join(then, "scope", "left").withColumns({"name": F.concat_ws("/", "scope", "source", F.col("block").cast("string")), "expires_at": expires, "skip": F.col("source").endswith("1")})
    staged = staged.withColumn("digest", F.sha2("name", 256))
    requests = staged.withColumn("seq", F.explode(F.array(F.col("least"), F.col("least") + 1_000_000_000)))
    log = staged.filter("source = 'src3'").select("digest", F.lit(5).alias("inserted"))
    return history.compare_and_set(requests, states, log, now).select("seq", "name", "outcome", "inserted")


_INTENTS = "intents AS (SELECT review_id, item_id, CASE WHEN review_id % 3 > 0 THEN decision END AS action, CASE WHEN review_id % 4 > 0 THEN item_id % 10 END AS part FROM review), expected AS (SELECT review_id, item_id, action, CASE WHEN review_id % 7 = 0 THEN 3 ELSE part END AS part FROM intents WHERE review_id % 2 = 0)"


@query(sql("SELECT review_id, item_id, action, part FROM intents i WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.review_id IS NOT DISTINCT FROM i.review_id AND e.item_id IS NOT DISTINCT FROM i.item_id AND e.action IS NOT DISTINCT FROM i.action AND e.part IS NOT DISTINCT FROM i.part)", _INTENTS))
def cleared_intents(s: SparkSession, d: str) -> DataFrame:
    """Intents left after those that are still as expected, nulls included, are deleted."""
    r = F.col("review_id")
    intents = v.review(s, d).select("review_id", "item_id", F.when(r % 3 > 0, F.col("decision")).alias("action"), F.when(r % 4 > 0, F.col("item_id") % 10).alias("part"))
    expected = intents.filter(r % 2 == 0).withColumn("part", F.when(r % 7 == 0, 3).otherwise(F.col("part")).cast("long"))
    return transitions.clear_matching(intents, expected)


@query(sql("SELECT review_id, CASE WHEN review_id % 3 = 0 THEN created_at WHEN review_id % 2 = 0 THEN TIMESTAMP '2000-01-01' END AS submitted_at FROM review"))
def submitted_marks(s: SparkSession, d: str) -> DataFrame:
    """Records marked as submitted, those that were keep their time."""
    index = v.review(s, d).select("review_id", F.when(F.col("review_id") % 3 == 0, F.col("created_at")).cast("timestamp_ntz").alias("submitted_at"))
    now = index.filter("review_id % 2 = 0").select("review_id", F.lit("2000-01-01").cast("timestamp_ntz").alias("submitted_at"))
    return transitions.mark_submitted(index, now, ["review_id"])


@query(sql("SELECT scope, batch_id, created_at FROM (SELECT review_id AS batch_id, item_id % 7 AS scope, created_at, decision FROM review) WHERE decision = 'UNSURE' QUALIFY row_number() OVER (PARTITION BY scope ORDER BY created_at, batch_id) = 1"))
def oldest_pending(s: SparkSession, d: str) -> DataFrame:
    """The pending batch of each scope that is the next to go out."""
    status = F.when(F.col("decision") == "UNSURE", "pending").otherwise("completed")
    rows = v.review(s, d).select(F.col("review_id").alias("batch_id"), (F.col("item_id") % 7).alias("scope"), "created_at", status.alias("status"))
    return transitions.oldest_pending(rows, "scope").select("scope", "batch_id", "created_at")
