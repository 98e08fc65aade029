"""Classification of import rows against a catalogue and earlier rows, as joins and windows instead of a loop.

1. INVALID_SPECIES: the category is missing or inactive; such rows claim no identity.
2. Of the rest, the first row of an identity stands for it; later ones with its material are EXACT_DUPLICATE, others
   CONFLICTING_SOURCE_IDENTITY. The first itself is compared with an earlier import of the identity in the same way.
3. Of the rows left, an earlier import of the URL makes them DUPLICATE_IMAGE_URL or, with any other category,
   CONFLICTING_IMAGE_SPECIES. Without one the first row of the URL is NEW, later ones are compared with it.

related is the row of the file compared with; null for earlier imports and for conflicts of an identity. Every outcome but
NEW is an issue; exact duplicates and repeated URLs don't block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKING = ("INVALID_SPECIES", "CONFLICTING_SOURCE_IDENTITY", "CONFLICTING_IMAGE_SPECIES")


def classify(rows: DataFrame, existing: DataFrame, categories: DataFrame) -> DataFrame:
    """rows with outcome and related_row. rows, existing: row, category, identity, url, material; categories: category."""
    known = rows.join(categories.select(F.col("category").alias("_c")), F.col("category") == F.col("_c"), "left").withColumn("invalid", F.col("_c").isNull()).drop("_c")
    invalid = known.filter("invalid").select("row", "category", "identity", "url", F.lit("INVALID_SPECIES").alias("outcome"), F.lit(None).cast("long").alias("related_row"))

    first = Window.partitionBy("identity").orderBy("row")
    known = known.filter("NOT invalid").withColumn("_first", F.first(F.struct("row", "material")).over(first))
    by_identity = existing.groupBy("identity").agg(F.min_by("material", "row").alias("_old"))
    known = known.join(by_identity, "identity", "left")
    later = F.col("row") != F.col("_first.row")
    compared = F.when(later, F.col("_first.material")).otherwise(F.col("_old"))
    outcome = F.when(later | F.col("_old").isNotNull(), F.when(F.col("material") == compared, "EXACT_DUPLICATE").otherwise("CONFLICTING_SOURCE_IDENTITY"))
    known = known.select("row", "category", "identity", "url", outcome.alias("outcome"), F.when(later & (F.col("material") == compared), F.col("_first.row")).alias("related_row"))

    by_url = existing.groupBy("url").agg(F.min("category").alias("_low"), F.max("category").alias("_high"))
    left = known.filter("outcome IS NULL").withColumn("_first", F.first(F.struct("row", "category")).over(Window.partitionBy("url").orderBy("row"))).join(by_url, "url", "left")
    in_file = F.col("_low").isNull()
    same = F.when(in_file, F.col("_first.category") == F.col("category")).otherwise((F.col("_low") == F.col("category")) & (F.col("_high") == F.col("category")))
    outcome = F.when(in_file & (F.col("row") == F.col("_first.row")), "NEW").when(same, "DUPLICATE_IMAGE_URL").otherwise("CONFLICTING_IMAGE_SPECIES")
    left = left.select("row", "category", "identity", "url", outcome.alias("outcome"), F.when(in_file & (F.col("row") != F.col("_first.row")), F.col("_first.row")).alias("related_row"))
    return invalid.unionByName(known.filter("outcome IS NOT NULL")).unionByName(left)


def issues(classified: DataFrame) -> DataFrame:
    """row, related_row, code, blocking of the rows that are not NEW."""
    return classified.filter(F.col("outcome") != "NEW").select("row", "related_row", F.col("outcome").alias("code"), F.col("outcome").isin(*BLOCKING).alias("blocking"))
