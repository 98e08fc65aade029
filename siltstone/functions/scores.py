"""Softmax and ranking of class scores, as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(z: Column) -> Column:
    """Probabilities of an array of scores; the greatest is shifted to 0 first. Null when empty or not finite."""
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    finite = (F.size(z) > 0) & F.forall(z, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(e, lambda x: x / total))


def ranked(z: Column) -> Column:
    """Structs (class, confidence), most confident first, ties by class."""
    pairs = F.transform(softmax(z), lambda p, i: F.struct((-p).alias("order"), i.alias("class"), p.alias("confidence")))
    return F.transform(F.array_sort(pairs), lambda r: F.struct(r["class"].alias("class"), r["confidence"].alias("confidence")))


def status(ranking: Column, threshold: float) -> Column:
    return F.when(ranking[0]["confidence"] >= threshold, "CANDIDATES").otherwise("LOW_CONFIDENCE")


def resized(width: Column, height: Column, short: int) -> Column:
    """Struct (width, height) with the shorter side at ``short``, the longer rounded down."""
    wide = width >= height
    return F.struct(F.when(wide, F.floor(width * short / height)).otherwise(short).alias("width"), F.when(wide, short).otherwise(F.floor(height * short / width)).alias("height"))
