"""Evaluation of ranked predictions. predictions: label, predicted, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, classes: Sequence[int]) -> DataFrame:
    """A row for each true label, a column p<class> for each predicted one."""
    return predictions.groupBy("label").agg(*[F.count_if(F.col("predicted") == c).alias(f"p{c}") for c in classes])


def by_class(predictions: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 of every class that is a label; null where undefined."""
    n = F.count(F.lit(1))
    cells = predictions.groupBy("label", "predicted").agg(n.alias("n"))
    true = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    joined = true.join(said, "class", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return joined.select("class", "support", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"))


def overall(predictions: DataFrame, top: int = 3) -> DataFrame:
    """One row: n, accuracy, macro_f1 (mean over the labels, 0 where a class has none) and top_rate, how often the label is among the ``top`` first of ``ranked``.

    predictions: label, predicted, ranked (array of classes, likeliest first).
    """
    right = lambda c: F.count_if(c) / F.count(F.lit(1))
    hit = F.array_contains(F.slice("ranked", 1, top), F.col("label"))
    facts = predictions.agg(F.count(F.lit(1)).alias("n"), right(F.col("label") == F.col("predicted")).alias("accuracy"), right(hit).alias("top_rate"))
    macro = by_class(predictions.select("label", "predicted")).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))
    return facts.join(macro).select("n", "accuracy", "macro_f1", "top_rate")


def sweep(predictions: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """threshold, n_above, coverage, precision, all thresholds in one aggregation."""
    right = F.col("predicted") == F.col("label")
    cells = []
    for t in thresholds:
        above = F.col("confidence") >= t
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(above).alias("n_above"), (F.count_if(above) / F.count(F.lit(1))).alias("coverage"), F.when(F.count_if(above) > 0, F.count_if(above & right) / F.count_if(above)).alias("precision")))
    return predictions.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def recommended(swept: DataFrame, precision: float = 0.85, coverage: float = 0.60) -> DataFrame:
    """The lowest threshold that is precise enough and covers enough."""
    return swept.filter((F.col("precision") >= precision) & (F.col("coverage") >= coverage)).agg(F.min("threshold").alias("threshold"))


def class_weights(support: DataFrame) -> DataFrame:
    """class, n, weight: 1 / sqrt(n), scaled to mean 1 over the classes."""
    w = 1 / F.sqrt("n")
    return support.select("class", "n", (w / F.avg(w).over(Window.partitionBy())).alias("weight"))


def parity(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """The greatest absolute difference of an array column between two runs, and whether its order agrees everywhere."""
    joined = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    order = lambda c: F.transform(F.array_sort(F.transform(c, lambda x, i: F.struct(-x, i.alias("i")))), lambda s: s["i"])
    return joined.agg(F.max(F.array_max(F.transform(F.arrays_zip("_a", "_b"), lambda p: F.abs(p["_a"] - p["_b"])))).alias("error"), F.min(order("_a") == order("_b")).alias("same_order"))
