"""Low-discrepancy source schedule: golden-ratio points pick the source of each slot of the mix.

Each source's documents are shuffled by hash and cut into blocks of equally many words. Slot i of the mix takes the
golden-ratio point frac(i * phi) through the cumulative target shares to a source; a slot's rank among its source's
slots picks the block (starting over after the last one). Joining slots and blocks gives the mixed stream.

Nulls: a null text has size 0; null sources form one source, ordered last. Sources and documents without words get
target 0 and nothing taken. Equal rows may share out blocks between them either way. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import positions
from siltstone.llm.exact_dedup import keys, rows_at
from siltstone.llm.storage import scope, written

WORD = r"[^\x20\x09-\x0D]+"
#: The golden ratio's fractional part, and that of 2^20 times it: i = a * 2^20 + b keeps the point exact to 1e-9.
_PHI, _PHI_20 = 0.6180339887498949, 0.6180339887498949 * 2**20 % 1
_BINS = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    block_words: int = 64


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, source_size, target, by water-filling: min(most * size, level * weight), summing to share of all sizes.

    The windows here run over one row per source.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(weights, ((F.row_number().over(by) - 1) % len(mix.weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(mix.most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * mix.share
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w_rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("level", (total - F.col("capped_before")) / F.col("w_rest"))
    s = s.withColumn("is_capped", F.col("cap") <= F.col("w") * F.col("level"))
    first_free = F.min(F.when(~F.col("is_capped"), F.struct("rank", "level"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.when(first_free.isNull() | (F.col("rank") < first_free["rank"]), F.col("cap")).otherwise(F.col("w") * first_free["level"]).alias("target"))


def golden(i: Column) -> Column:
    a, b = F.shiftright(i, 20).cast("double"), i.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")
    x = a * _PHI_20 % F.lit(1.0) + b * _PHI
    return x - F.floor(x)


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, source, rank: the source of each slot, and the slot's rank among its source's. sources: source, target."""
    spark = sources.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.col("target") / F.sum("target").over(Window.partitionBy())
    s = sources.filter("target > 0").select("source", F.sum(share).over(upto).alias("hi"), share.alias("share"), F.row_number().over(upto.orderBy(F.col("source").desc_nulls_first())).alias("last"))
    s = s.select("source", F.greatest(F.col("hi") - F.col("share"), F.lit(0.0)).alias("lo"), F.when(F.col("last") == 1, 2.0).otherwise(F.col("hi")).alias("hi"))
    # the next source begins exactly where this one ends
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    ranges = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * _BINS).cast("int"), F.least(F.floor(F.col("hi") * _BINS), F.lit(_BINS - 1)).cast("int"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("point")).withColumn("bin", F.floor(F.col("point") * _BINS).cast("int"))
    picked = points.join(ranges, "bin").filter("point >= lo AND point < hi")
    picked = picked.select("slot", "source", F.floor(F.col("slot") * F.lit(float(1 << positions.bits_for(slots)) / max(1, slots))).cast("int").alias("chunk"))
    return positions.running(written(picked, "slots"), ["source"], "chunk", ["slot"], F.lit(1).cast("long"), "rank").select("slot", "source", "rank")


def stream(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """slot, uid, start, words: the mixed stream, as pieces of documents (words start.. of document uid) in slots.

    rows: uid, source, size, h (a hash that fixes the order within the source).
    """
    b = mix.block_words
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = schedule(sources, round(total / b))
    # one rank more than "most" rounds of blocks would repeat a document too often
    slots = slots.join(sources.select(F.col("source").alias("_s"), F.ceil(F.col("source_size") / b).alias("blocks")), F.col("source").eqNullSafe(F.col("_s"))).filter(F.col("rank") < mix.most * F.col("blocks"))
    slots = slots.select("slot", F.col("source").alias("_s"), (F.col("rank") % F.col("blocks")).alias("_b"))
    bits = positions.bits_for(rows.count())
    at = positions.running(rows.filter("size > 0").withColumn("_bucket", positions.hash_bucket(F.col("h"), bits)), ["source"], "_bucket", ["h", "uid"], F.col("size"), "at")
    end = F.col("at") + F.col("size")
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((end - 1) / b))))
    pieces = pieces.select("uid", "source", "block", F.greatest(F.col("block") * b - F.col("at"), F.lit(0)).alias("start"), (F.least(end, (F.col("block") + 1) * b) - F.greatest(F.col("at"), F.col("block") * b)).alias("words"))
    return pieces.join(slots, (F.col("block") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s"))).select("slot", "uid", "start", "words")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """uid, doc_id, source, size, h and ``keep`` for every row, written once."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", *keep, size.alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    return written(rows, "sized", outlive=True)


def taken(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """uid, taken: how many words of each document the mix takes, repeats counted; documents not taken are absent."""
    return written(stream(rows, sources, mix).groupBy("uid").agg(F.sum("words").alias("taken")), "taken", outlive=True)


def mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every document."""
    with scope(docs.sparkSession):
        rows = sized(docs)
        sources = written(targets(rows, mix), "targets", outlive=True)
        t = taken(rows, sources, mix)
    s = sources.select(F.col("source").alias("_s"), "source_size", "target")
    out = rows.join(t, "uid", "left").join(F.broadcast(s) if _small(sources) else s, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def _small(sources: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast; a larger one is joined by shuffling."""
    return sources.count() <= most


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents of the mix, whole: each as many times as the mix begins it.

    A source's blocks are taken in order, round after round, so only the document at which its last round ends is taken
    in part; it counts whole, and each source has its target to within a document. Documents without words stay once.
    Rows come in no particular order; repeated rows are mixed each. Extra columns may have any names.
    """
    names = docs.columns
    docs, rows = keys(docs, names, "doc_id", "source", "text")
    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            rows = sized(rows, "_file", "_row")
            sources = written(targets(rows, mix), "targets")
            t = taken(rows, sources, mix)
        with_taken = rows.join(t, "uid", "left")
        # a source too small for a block of its own, of which no slot took any, begins its first document
        missed = with_taken.filter("size > 0").groupBy("source").agg(F.max("taken").alias("most"), F.min(F.struct("h", "uid")).alias("first"))
        missed = missed.filter("most IS NULL").select(F.col("first.uid").alias("uid"), F.lit(1).alias("begun"))
        times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.coalesce("taken", "begun", F.lit(0)) / F.col("size"))).cast("int")
        times = with_taken.join(missed, "uid", "left").select("_file", "_row", times.alias("times"))
        times = written(times.filter("times > 0"), "times", outlive=True)
    times = times.select("_file", "_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return rows_at(docs, names, times, "inner")
