"""Running totals over any number of rows without putting a group into one task.

Rows carry a ``bucket`` that rises with the wanted order. Totals per bucket give each bucket its offset (a
window over at most as many rows as there are buckets), and a window inside each bucket adds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a bucket, on average, that ``bits_for`` aims at.
BUCKET_ROWS = 1 << 16
#: Offsets of at most so many buckets are broadcast.
BROADCAST_BUCKETS = 100_000


def bits_for(rows: int) -> int:
    """Leading bits of a hash that deal so many rows into buckets of about BUCKET_ROWS: 1024 buckets at least, 2^24 at most."""
    return min(24, max(10, (rows // BUCKET_ROWS).bit_length()))


def hash_bucket(h: Column, bits: int) -> Column:
    """The leading bits of a 64-bit hash: rises with the hash read as unsigned."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str, *, buckets: int | None = None, nulls: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before it in its group, ordered by bucket, then order.

    ``df`` is read twice: pass a written table. Nulls in ``group`` form a group. ``buckets``: how many pairs of group and
    bucket there can be; up to BROADCAST_BUCKETS their offsets are broadcast. ``nulls``: whether ``group`` may hold any.
    """
    keys = [*group, bucket]
    df = df.withColumn("_v", value)
    totals = df.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k).eqNullSafe(F.col(f"_k{i}")) if nulls and k != bucket else F.col(k) == F.col(f"_k{i}"))
    small = buckets is not None and buckets <= BROADCAST_BUCKETS
    joined = local.join(F.broadcast(offsets) if small else offsets, on, "inner")
    return joined.withColumn(name, F.col("_offset") + F.col("_local")).drop("_v", "_offset", "_local", *[f"_k{i}" for i in range(len(keys))])
