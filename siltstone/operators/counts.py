"""Counters with bounded detail: capped keys, grouped issues, bounded issue lists, bounded chunks, quotas, violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "__OTHER__"


def capped_counts(df: DataFrame, key: str, ordinal: str, most: int = 1000) -> DataFrame:
    """Counts of the ``most`` keys that come first; all later keys count together as OTHER. A report with a fixed size."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("_first"))
    firsts = counted.orderBy("_first", key).limit(most).select(F.col(key).alias("_kept"))
    named = counted.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("_kept")), "left")
    return named.groupBy(F.when(F.col("_kept").isNull(), F.lit(OTHER)).otherwise(F.col(key)).alias(key)).agg(F.sum("n").alias("n"))


def issue_groups(issues: DataFrame, most: int = 10, group: Sequence[str] = ("code", "blocking")) -> DataFrame:
    """Columns of ``group`` (null is a value): count, the first ``most`` (row, related_row) and how many more there are.

    An import's report groups by code, message, blocking and host. A group's samples are the least of what its tasks
    keep, so a group that holds a third of all issues isn't gathered anywhere.
    """
    keyed = issues.select(*group, F.struct("row", "related_row").alias("_s"))
    by = Window.partitionBy(*group).orderBy("_s")
    ranked = keyed.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most)
    samples = ranked.groupBy(*group).agg(F.array_sort(F.collect_list("_s")).alias("samples"))
    counted = issues.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for c in group:
        same = same & counted[c].eqNullSafe(samples[c])
    return counted.join(samples, same).select(*[counted[c] for c in group], "n", "samples", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("omitted"))


def bounded_details(issues: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` issues by row, in which later blocking issues replace the last that don't block. A report with a fixed size.

    Only the first ``most`` issues and the first ``most`` later blocking ones can be in it, so both sides are limited
    before the windows.
    """
    first = issues.orderBy("row").limit(most)
    # the row after which an issue is no longer among the first
    edge = first.agg(F.max("row").alias("_edge"))
    later = issues.filter("blocking").join(F.broadcast(edge), F.col("row") > F.col("_edge")).drop("_edge").orderBy("row").limit(most)
    yields = first.filter("NOT blocking").withColumn("_place", F.row_number().over(Window.orderBy(F.desc("row"))))
    comes = later.withColumn("_place", F.row_number().over(Window.orderBy("row")))
    evicted = yields.join(comes.select("_place"), "_place", "left_semi").select("row")
    enters = comes.join(yields.select("_place"), "_place", "left_semi").drop("_place")
    return first.join(evicted, "row", "left_anti").unionByName(enters.select(*first.columns))


def bounded_chunk(df: DataFrame, order: Sequence[str], size: Column, most_rows: int, most_bytes: int, header: int = 0) -> DataFrame:
    """The longest prefix of the order with at most so many rows and bytes.

    A prefix has at most ``most_rows`` rows, so the order is cut there (each task keeps as many) before the running sum.
    """
    rows = df.withColumn("bytes", size.cast("long")).orderBy(*order).limit(most_rows)
    running = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + header
    return rows.withColumn("running_bytes", running).filter(F.col("running_bytes") <= most_bytes)


def quota_fill(rows: DataFrame, group: str, source: str, ordinal: str, sources: Sequence[str], quota: int) -> DataFrame:
    """Rows taken per group up to ``quota``, sources in the given order, rows by ordinal.

    Taking as many as are still wanted from each source in turn is a prefix of the order (source, ordinal), and a
    source's first ``quota`` rows suffice.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source))
    ranked = rows.withColumn("_place", place).filter("_place > 0")
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(group, source).orderBy(ordinal))).filter(F.col("_n") <= quota)
    ranked = ranked.withColumn("taken_as", F.row_number().over(Window.partitionBy(group).orderBy("_place", ordinal))).filter(F.col("taken_as") <= quota)
    return ranked.drop("_place", "_n")


def shortfall(taken: DataFrame, groups: DataFrame, group: str, quota: int) -> DataFrame:
    """group, n, missing for every group."""
    counted = taken.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counted, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0).cast("long"), quota - F.coalesce("n", F.lit(0))).alias("missing"))


def copy_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, n: rows of either side that the other lacks, as sets."""
    lost = lambda x, y, side: x.subtract(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return lost(a, b, "missing").unionAll(lost(b, a, "added"))


def violations(name: str, rows: DataFrame) -> DataFrame:
    """check, n: how many rows break a rule."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
