"""Streaming queries run to the end of their input; same results as their batch forms."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import catalogue
from siltstone.plans import views as v
from siltstone.plans.views import sql
from siltstone.sources import scratch
from siltstone.streaming import expiry, limiter, limits


#: State of timers and other keyed state is kept on disk, by changes rather than whole files, without room set aside in advance.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def _drained(spark: SparkSession, out: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs an append query over all that is there and reads what it wrote."""
    folder = scratch.folder(spark, name)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, x in (settings or {}).items():
            spark.conf.set(k, x)
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def _stream(spark: SparkSession, table: DataFrame, name: str, files: int) -> DataFrame:
    """The table as a stream of several files, as a source would deliver it."""
    folder = scratch.folder(spark, name)
    table.repartition(files).write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(folder)


@catalogue.query(catalogue.ORACLE["failure_lock"])
def failure_lock_stream(s: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    attempts = v.table(s, d, "events").select((F.col("user_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (kind == "error").alias("failure"), (kind == "signup").alias("success"))
    out = _drained(s, limiter.failure_locks(_stream(s, attempts, "attempts", 4), 20 * 86400), "locks")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("locked_until", F.col("locked_until").cast("timestamp_ntz"))


@catalogue.query(sql("SELECT item_id, max(review_id) AS version, arg_max(decision, review_id) AS decision FROM review GROUP BY item_id"))
def latest_state_stream(s: SparkSession, d: str) -> DataFrame:
    stream = _stream(s, v.review(s, d).select("item_id", F.col("review_id").alias("version"), "decision"), "reviews", 4)
    folder = scratch.folder(s, "states")
    newest = limiter.latest_state(stream, "item_id", "version", "decision")

    def save(changed: DataFrame, epoch: int) -> None:
        changed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/epoch-{epoch:012d}")

    newest.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    return rows.groupBy("item_id").agg(F.max(F.struct("version", "decision")).alias("s")).select("item_id", "s.version", "s.decision")


#: Each document as a preview that is opened, lives for 15 minutes and, two in three, is committed some time later.
_PREVIEWS = """SELECT doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id * 7) AS ts, TRUE AS opened FROM {docs}
    UNION ALL SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id * 7 + length(coalesce(text, '')) % 1800), FALSE FROM {docs} WHERE doc_id % 3 <> 0"""


@catalogue.query("""WITH previews AS (SELECT doc_id AS id, doc_id * 7 AS opened, CASE WHEN doc_id % 3 <> 0 THEN doc_id * 7 + length(coalesce(text, '')) % 1800 END AS closed FROM documents), seen AS (SELECT max(greatest(opened, coalesce(closed, opened))) AS until FROM previews)
    SELECT id, CASE WHEN closed < opened + 900 THEN 'closed' ELSE 'expired' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CASE WHEN closed < opened + 900 THEN closed ELSE opened + 900 END) AS at FROM previews, seen WHERE closed IS NOT NULL OR opened + 900 <= until""")
def preview_expiry_stream(s: SparkSession, d: str) -> DataFrame:
    events = s.sql(_PREVIEWS, docs=v.table(s, d, "documents"))
    out = _drained(s, expiry.expiries(_stream(s, events, "previews", 4), timedelta(minutes=15)), "expiries", _ROCKS)
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@catalogue.query()
def limit_stream(s: SparkSession, d: str) -> DataFrame:
    """Attempts made of documents, four a source and some of other clients; tested against a plain loop that evicts."""
    client = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("source", F.lit("")), F.lit("/"), (F.col("doc_id") % 4).cast("string"))).otherwise(F.concat(F.lit("c"), (F.length(F.coalesce("text", F.lit(""))) % 50_000).cast("string")))
    attempts = v.table(s, d, "documents").select(client.alias("client"), F.timestamp_seconds(1_704_067_200 + F.col("doc_id") * 3).alias("ts"), F.col("doc_id").alias("seq"), (F.length(F.coalesce("text", F.lit(""))) % 4 != 0).alias("failure"))
    out = limits.drained(s, _stream(s, attempts, "client-attempts", 4))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("locked_until", F.col("locked_until").cast("timestamp_ntz"))
