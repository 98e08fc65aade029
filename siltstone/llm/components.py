"""Connected components of a graph given by its edges, by alternating large and small stars.

Every round is joins and aggregations over edges, written to the shared folder; nodes with many neighbours are folded
before the shuffle (minimum per node) or kept out of it (``skew.join``). Nothing is gathered on the driver but whether
to go on. Edges with a null end are ignored, as are loops; edges may repeat; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import skew
from siltstone.llm.storage import scope, written


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node that itself has none."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    seen = nodes.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    total = edges.count() * 2
    hot = least.filter((F.col("n") >= skew.HOT_LEAST) & (F.col("n") * skew.HOT_SHARE >= total)).select("a")
    return skew.join(both, least.select("a", "m"), "a", hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from larger to smaller nodes here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node but the least of each component.

    edges: a, b of one type that can be ordered, each pair once or more, in either direction; loops are ignored.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with scope(edges.sparkSession):
        edges = written(edges, "edges")
        while not _is_forest_of_stars(edges):
            edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        labels = written(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels", outlive=True)
    return labels
