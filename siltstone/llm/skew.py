"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import written

#: A key with one row in so many is hot; there are at most as many hot keys, whatever the number of rows.
HOT_SHARE = 1000
#: Keys of fewer rows are never hot.
HOT_LEAST = 50


def hot_keys(rows: DataFrame, key: str, *, outlive: bool = False) -> DataFrame:
    """The keys that hold at least one row in HOT_SHARE: HOT_SHARE rows at most. Counts are folded before the shuffle."""
    counts = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= HOT_LEAST), "key-counts")
    total = rows.count()
    return written(counts.filter(F.col("_n") * HOT_SHARE >= total).select(key), "hot-keys", outlive=outlive)


def join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (one row a key). Rows of hot keys never meet in a shuffle: their right rows are broadcast.

    how: inner or left. A null key is never hot.
    """
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(hot)
    often = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return often.unionByName(left.join(few, key, "left_anti").join(right, key, how))
