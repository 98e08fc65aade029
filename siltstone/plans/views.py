"""Review-domain views over the driver tables, as DataFrames and as the SQL that defines the same rows.

item: what is reviewed. category: its kind. review: a decision on an item. current_review: the newest of an item, unless it was withdrawn.
local_item: what a past export left at a remote copy. manifest: rows of an import file and of earlier imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBERS = 6
#: Members who joined lately and have neither reviews nor open items.
NEW_MEMBERS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, d, "nation").select(key.alias("category_id"), F.concat(F.lit("N"), F.lpad(key.cast("string"), 3, "0")).alias("code"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 4).alias("active"), F.col("n_regionkey").alias("sort_order"))


def item(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("item_id"), F.col("c_nationkey").alias("category_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("record_id"), (F.col("c_acctbal") >= 0).alias("active"), F.when(key % 7 == 0, key % MEMBERS).alias("open_member"))


def review(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "REJECTED").otherwise("UNSURE")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % MEMBERS).alias("member"), decision.alias("decision"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").eqNullSafe("5-LOW").alias("withdrawn"))


def current_review(spark: SparkSession, d: str) -> DataFrame:
    newest = Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("review_id"))
    return review(spark, d).withColumn("_n", F.row_number().over(newest)).filter("_n = 1 AND NOT withdrawn").drop("_n", "withdrawn")


def local_item(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("item_id"))
    action = F.when(F.col("l_returnflag") == "A", "ADD").when(F.col("l_returnflag") == "N", "MOVE").otherwise("REMOVE")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        "item_id", F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), action.alias("action"),
        (F.col("l_linestatus") == "F").alias("succeeded"), F.col("l_shipdate").alias("succeeded_at"), (F.col("l_quantity") > 40).alias("original_changed"),
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    identity = F.when(n % 2 == 0, F.substring(F.sha2("text", 256), 1, 12)).otherwise(F.concat(F.lit("d"), (n % 350).cast("string")))
    return table(spark, d, "documents").select(n.alias("row"), F.col("lang").alias("category"), identity.alias("identity"), (F.col("n_chars") % 400).alias("url"), F.sha2(F.concat_ws("|", "text", "lang", F.col("n_chars").cast("string")), 256).alias("material"), F.col("source"), (n % 5 == 0).alias("earlier"))


CATEGORY = "category AS (SELECT n_nationkey AS category_id, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, n_name AS name, n_regionkey <> 4 AS active, n_regionkey AS sort_order FROM nation)"
ITEM = f"item AS (SELECT c_custkey AS item_id, c_nationkey AS category_id, c_mktsegment AS source, c_name AS record_id, c_acctbal >= 0 AS active, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % {MEMBERS} END AS open_member FROM customer)"
REVIEW = f"review AS (SELECT o_orderkey AS review_id, o_custkey AS item_id, o_orderkey % {MEMBERS} AS member, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REJECTED' ELSE 'UNSURE' END AS decision, o_orderdate AS created_at, o_orderpriority IS NOT DISTINCT FROM '5-LOW' AS withdrawn FROM orders)"
CURRENT = "current_review AS (SELECT * EXCLUDE (withdrawn) FROM (SELECT * FROM review QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, review_id DESC) = 1) WHERE NOT withdrawn)"
LOCAL = "local_item AS (SELECT o_custkey AS item_id, l_orderkey AS review_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CASE l_returnflag WHEN 'A' THEN 'ADD' WHEN 'N' THEN 'MOVE' ELSE 'REMOVE' END AS action, l_linestatus = 'F' AS succeeded, l_shipdate AS succeeded_at, l_quantity > 40 AS original_changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
MANIFEST = "manifest AS (SELECT doc_id AS row, lang AS category, CASE WHEN doc_id % 2 = 0 THEN substr(sha256(text), 1, 12) ELSE 'd' || CAST(doc_id % 350 AS VARCHAR) END AS identity, n_chars % 400 AS url, sha256(text || '|' || lang || '|' || CAST(n_chars AS VARCHAR)) AS material, source, doc_id % 5 = 0 AS earlier FROM documents)"
ALL = ", ".join([CATEGORY, ITEM, REVIEW, CURRENT, LOCAL, MANIFEST])


def sql(query: str, *more: str) -> str:
    """``query`` with all views above it."""
    return f"WITH {', '.join([ALL, *more])} {query}"
