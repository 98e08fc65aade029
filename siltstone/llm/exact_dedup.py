"""Stateful streaming deduplication of equal texts.

A stream of (digest, doc_id, content locator) updates keyed state in RocksDB that never expires: for each digest the
row that stays (largest doc_id), its locator (file and row) and the number of rows. Partial aggregation before the
state's shuffle folds a digest that holds a third of all rows to one row a task. Rows whose digest was seen more than
once are hits: their full text is compared with the text at the kept row's locator, and rows that differ (a digest
collision) are grouped by their text instead.

Nulls: a null text counts as empty; a null doc_id is less than any other. Of rows with the same largest doc_id and
text, the last by file and row stays. An empty table gives an empty result. Extra columns are ignored, whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import skew
from siltstone.llm.storage import new_path, scope, unused, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # stores of a stream that has ended are closed after so long, not a minute
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def filed(docs: DataFrame) -> DataFrame:
    """``docs`` as a frame that is read from files: written first if it isn't, or if its columns hide the files' metadata."""
    if "_metadata" not in [c.lower() for c in docs.columns]:
        try:
            docs.select("_metadata.file_path")
        except AnalysisException:
            pass
        else:
            return docs
    return written(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), "documents")


def located(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """``docs``, read from files, with the file and row of each document."""
    return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def keys(docs: DataFrame, names: list[str], *columns: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` read from files, and its ``columns`` with _file and _row. names: what ``docs`` calls its columns."""
    docs = filed(docs)
    return docs, docs.select(*[F.col(f"`{docs.columns[names.index(c)]}`").alias(c) for c in columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def rows_at(docs: DataFrame, names: list[str], places: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` (read from files) joined with ``places`` (_file, _row) by ``how``; columns are called ``names`` again."""
    file, row = unused("_file", docs.columns), unused("_row", docs.columns)
    # never broadcast: places grow with the documents
    places = places.select(F.col("_file").alias(file), F.col("_row").alias(row)).hint("merge")
    joined = located(docs, file, row).join(places, [file, row], how)
    return joined.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])


def digest_log(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, _file, _row, text_sha256 of rows with doc_id, text, _file, _row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", digest(text).alias("digest"), "_file", "_row", F.sha2(text, 256).alias("text_sha256"))


def deduplicate_stream(stream: DataFrame, checkpoint: str, out: str):
    """Start the stateful query over a stream of digest-log rows; each epoch appends the states that it changed."""
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def save(changed: DataFrame, epoch: int) -> None:
        changed.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/part-of-{epoch:012d}")

    return state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_states(spark: SparkSession, log: DataFrame, path: str, files_per_epoch: int = 512) -> DataFrame:
    """digest, keep, group_size after all files of the log at ``path`` went through the stateful stream."""
    checkpoint, out = new_path(spark, "dedup-state"), new_path(spark, "dedup-epochs")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_per_epoch).parquet(path)
        query = deduplicate_stream(stream, checkpoint, out)
        query.awaitTermination()
        epochs = len(query.recentProgress)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, keep struct<doc_id:{}, _file:string, _row:bigint>, group_size bigint, epoch bigint".format(log.schema["doc_id"].dataType.simpleString())
    if not epochs:
        return spark.createDataFrame([], schema).drop("epoch")
    states = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    last = states.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "epoch").alias("s"))
    return last.select("digest", "s.keep", "s.group_size")


def decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_epoch: int = 512) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, _file, _row for every row."""
    return _decisions(keys(docs, docs.columns, "doc_id", "text")[1], digest, files_per_epoch)


def _decisions(rows: DataFrame, digest: Callable[[Column], Column], files_per_epoch: int) -> DataFrame:
    spark = rows.sparkSession
    path = new_path(spark, "digests")
    digest_log(rows, digest).write.parquet(path)
    log = spark.read.parquet(path)
    with scope(spark):
        states = written(stream_states(spark, log, path, files_per_epoch), "states", outlive=True)
        hot = skew.hot_keys(log, "digest", outlive=True)
        differ = written(_collisions(rows, states, digest, hot), "collisions", outlive=True)
    out = skew.join(log, states, "digest", hot).withColumn("kept", _at_keep())
    out = out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256", "_file", "_row", "digest")
    if not differ.isEmpty():
        out = _split_collisions(out, differ)
    return out.drop("digest")


def _collisions(rows: DataFrame, states: DataFrame, digest: Callable[[Column], Column], hot: DataFrame) -> DataFrame:
    """digest, doc_id, _file, _row, text of the hits whose full bytes differ from the row that stays.

    The texts that stay for hot digests are broadcast: each is in one row of 1000 at least, so together they are no longer
    than 1000 texts of mean length. Other hits meet the text that stays in a shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = rows.select(digest(text).alias("digest"), "doc_id", "_file", "_row", text.alias("text"))
    several = states.filter("group_size > 1").select("digest", "keep")
    hits = hashed.join(F.broadcast(hot), "digest", "left_anti").join(several, "digest").withColumn("kept", _at_keep())
    # the text that stays is its digest's first
    first = Window.partitionBy("digest").orderBy(F.desc("kept")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hits.withColumn("kept_text", F.first("text").over(first)).filter("NOT kept AND text <> kept_text").select("digest", "doc_id", "_file", "_row", "text")
    if hot.isEmpty():
        return out
    hits = hashed.join(F.broadcast(several.join(F.broadcast(hot), "digest", "left_semi")), "digest").withColumn("kept", _at_keep())
    kept = hits.filter("kept").select("digest", F.col("text").alias("kept_text"))
    return out.unionAll(hits.filter("NOT kept").join(F.broadcast(kept), "digest").filter("text <> kept_text").select("digest", "doc_id", "_file", "_row", "text"))


def _at_keep() -> Column:
    return (F.col("_file") == F.col("keep._file")) & (F.col("_row") == F.col("keep._row"))


def _split_collisions(out: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows of ``differ`` leave the group of their digest and form groups by text."""
    groups = differ.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "_file", "_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    moved = differ.join(groups, ["digest", "text"]).select("_file", "_row", "keep", "n")
    lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    out = out.join(lost, "digest", "left").join(moved, ["_file", "_row"], "left")
    return out.select(
        "doc_id", F.when(F.col("n").isNull(), F.col("keep_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.when(F.col("n").isNull(), F.col("kept")).otherwise(_at_keep()).alias("kept"), "text_sha256", "_file", "_row", "digest",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns."""
    names = docs.columns
    docs, rows = keys(docs, names, "doc_id", "text")
    with scope(docs.sparkSession):
        dropped = written(_decisions(rows, sha256, 512).filter("NOT kept").select("_file", "_row"), "dropped", outlive=True)
    return rows_at(docs, names, dropped, "left_anti")
