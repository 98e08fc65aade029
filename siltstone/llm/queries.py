"""The numbered queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, divergence, exact_dedup, filter_audit, imatch, language_model, mixing, packing, passages, secrets, sharding, simhash, toxicity
from siltstone.llm.storage import documents


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), packing.Packing(public_tokenizers.path("byte_bpe_50k.json")))


def op3_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(documents(spark, sf_dir)).drop("_file", "_row")


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(documents(spark, sf_dir))


def op6_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree()
    return sharding.assign(documents(spark, sf_dir), tree, sharding.grown(tree, 24))


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), toxicity.remainder(F.col("doc_id"), 5) == 1)


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_edits(documents(spark, sf_dir))


def op9_passage_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), mixing.Mix())


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_mixture_packing, op3_streaming_exact_dedup, op4_compression_toxicity, op5_credential_linking,
        op6_hash_tree_sharding, op7_backoff_automaton, op8_imatch_fingerprints, op9_passage_automata, op10_source_mixing,
        op11_filter_interaction_audit, op12_suffix_decontamination, op13_source_divergence,
    )
}

#: DuckDB SQL for those that SQL can express; the others are tested against plain versions.
ORACLE: dict[str, str] = {
    "op3_streaming_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_passage_automata": r"""WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs),
        repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM starts) QUALIFY count(*) OVER (PARTITION BY s) > 1),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
        words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op11_filter_interaction_audit": r"""WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        counted AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs),
        said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            [len(ws) < 100, 100 * list_unique(ws) < 80 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
             coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
            FROM counted LEFT JOIN said USING (doc_id)),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
        cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic, len(list_filter(fails, lambda f: f)) AS n_fails FROM failed GROUP BY ALL),
        judged AS (SELECT *, fails[ascii(filter_order[step]) - 64] AS here, len(list_filter(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])) > 0 AS gone FROM cells, steps),
        metrics AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (here AND NOT gone), 0) AS BIGINT) AS removed,
            CAST(coalesce(sum(n) FILTER (here AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
            CAST(coalesce(sum(n_good) FILTER (here AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (here AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM judged GROUP BY part, filter_order, step)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM metrics""",
    "op12_suffix_decontamination": r"""WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM item WHERE len(ws) > 0)),
        docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        starts AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
        found AS (SELECT r, i, windows.n, item_id FROM starts JOIN windows ON windows.n = starts.n AND array_to_string(ws[i:i + starts.n - 1], ' ') = s),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op13_source_divergence": r"""WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        terms AS (SELECT r, lang, source, unnest(ws) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS c FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
        cells AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(x.c, 0) + 1) // (g.n + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.c + 1) // (langs.n + v) AS q
            FROM sizes g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM cells WHERE c > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200""",
}
