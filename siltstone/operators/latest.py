"""Latest, first and ranked rows per key. Every order ends in a key, so that survivors never depend on arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps n rows a task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def nth(keys: Sequence[str]) -> Column:
    """1, 2 and so on within each key, in any order. It needs rows sorted by the keys and no more, so rows that are sorted for a join or by ``first_by`` aren't sorted or kept again."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def first_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row a key, the first by ``ordinal``. Of a wide table only ordinals are shuffled with the keys."""
    return first_by(df, keys, [F.col(ordinal)])


def resume_merge(existing: DataFrame, new: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Existing rows first, then new ones; of equal keys the first stays."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return first_by(both, keys, [F.col("_side"), F.col(ordinal)]).drop("_side")


def present_with(df: DataFrame, key: str, digest: str, order: Sequence[Column], present: Column) -> DataFrame:
    """For each digest, the newest row that holds it and is itself its key's newest row and present."""
    return first_by(first_by(df, [key], order).filter(present), [digest], order)


def carry_forward(rows: DataFrame, previous: DataFrame, key: str, identity: Sequence[str], progress: Sequence[str]) -> DataFrame:
    """``progress`` columns from ``previous`` where the key and every identity column agree, nulls included."""
    old = previous.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_i_{c}") for c in identity], *[F.col(c).alias(f"_p_{c}") for c in progress])
    same = F.col(key) == F.col("_key")
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_i_{c}"))
    joined = rows.join(old, same, "left")
    found = F.col("_key").isNotNull()
    return joined.select(*[F.when(found, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in progress else F.col(c) for c in rows.columns])
