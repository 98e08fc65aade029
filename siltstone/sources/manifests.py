"""Readers and writers of manifests, configurations and receipts, with explicit schemas.

Header rules are checked on the header line alone; rows are never gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import canonical_json, text, urls
from siltstone.sources import ordered_csv, strict_csv

#: The columns of the item manifest, the export file and the canonical manifest, in order; what an import needs.
MANIFEST = (
    "image_id", "seafood_code", "app_label", "scientific_name", "source_dataset", "source_record_id", "source_taxon_match", "source_url", "image_url", "creator", "attribution", "license", "license_url",
    "source_observation_quality", "source_country", "source_split", "image_context", "original_group_id", "source_location", "source_date", "whole_fish", "exact_species_verified", "verified_by",
    "verification_notes", "sha256", "perceptual_hash", "local_path", "split", "status", "rejection_reason",
)
EXPORT = (
    "batch_id", "receipt_token", "action", "candidate_id", "review_id", "review_version", "species_code", "target_relative_path", "previous_relative_path", "preview_url", "original_url", "source_url",
    "creator", "license", "license_url", "attribution", "image_origin_allowlist",
)
REQUIRED = ("seafood_code", "source_dataset", "source_record_id", "source_url", "image_url", "license")
CANONICAL = ("candidate_id", "review_id", "review_version", "species_code", "relative_path", "sha256", "source_url", "creator", "license", "license_url", "attribution")

RECEIPT = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("candidate_id", T.StringType()), T.StructField("review_id", T.StringType()), T.StructField("review_version", T.LongType()), T.StructField("status", T.StringType()),
        T.StructField("sha256", T.StringType()), T.StructField("relative_path", T.StringType()), T.StructField("error", T.StringType()),
    ]))),
])
CONFIG = "schema_version int, generated_at timestamp, species array<struct<seafood_code:string,name_zh:string,name_en:string,scientific_name:string,candidate_count:bigint,inat_taxon_id:bigint,gbif_taxon_key:bigint,commons_category:string,fish_vista_filter:string>>"
CONFIG_FIELDS = ("seafood_code", "name_zh", "name_en", "scientific_name", "candidate_count", "inat_taxon_id", "gbif_taxon_key", "commons_category", "fish_vista_filter")
#: Limits of files and fields, and names of images.
IMPORT_BYTES, IMPORT_ROWS, EXPORT_BYTES, EXPORT_ROWS, FIELD_CHARS = 5 * 1024 * 1024, 50_000, 20 * 1024 * 1024, 10_000, 4_096
SUFFIX = r"(?i:\.(?:jpg|jpeg|png|webp|gif|tif|tiff|bmp|image))"
UUID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"


class BadFile(ValueError):
    """A file that must be rejected as a whole."""


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line of a CSV file, without a byte-order mark."""
    line = spark.read.text(path).first()
    if line is None:
        raise BadFile("empty file")
    names = spark.createDataFrame([(line[0].lstrip("﻿"),)], "line string").select(F.from_csv("line", ", ".join(f"_{i} string" for i in range(line[0].count(",") + 1))).alias("c")).select("c.*").first()
    return [n or "" for n in names]


def header_problems(names: Sequence[str], required: Sequence[str], exact: bool = False) -> list[str]:
    """What is wrong with a header: blank, untrimmed, with control characters, repeated, or not as required."""
    out = []
    for n in names:
        if not n.strip():
            out.append("BLANK_HEADER")
        elif n != n.strip() or any(ord(c) < 32 or ord(c) == 127 for c in n):
            out.append("BAD_HEADER")
    if len(set(names)) != len(names):
        out.append("REPEATED_HEADER")
    if exact and list(names) != list(required):
        out.append("HEADER_ORDER")
    if missing := [c for c in required if c not in names]:
        out.append("MISSING_HEADER:" + ",".join(missing))
    return out


def read_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """All columns as text, with _ragged for rows of another length; quoted fields may hold line ends."""
    schema = T.StructType([*[T.StructField(n.lstrip("﻿"), T.StringType()) for n in names], T.StructField("_ragged", T.StringType())])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_ragged", enforceSchema=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The 30 manifest columns, '' where the file lacks one or has no value; no file, no rows."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in MANIFEST))
    names = header(spark, path)
    rows = read_csv(spark, path, names)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in MANIFEST])


def strict_rows(spark: SparkSession, path: str, columns: Sequence[str], most_bytes: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """_record and ``columns`` as text, of files that are sound from end to end, or BadFile: size, UTF-8, quotes and line ends, header, fields a record."""
    found = strict_csv.read(spark, path, strict_csv.Dialect(rfc=True), block_bytes)
    if most_bytes is not None and not found.files.filter(F.col("size") > most_bytes).isEmpty():
        raise BadFile("FILE_TOO_LARGE")
    if bad := found.files.filter("NOT valid OR error IS NOT NULL").orderBy("file").first():
        raise BadFile(f"{bad['error']} in record {bad['error_record']}" if bad["valid"] else "BAD_ENCODING")
    if not found.files.filter("records = 0").isEmpty():
        raise BadFile("empty file")
    for r in found.records.filter("record = 1").select("fields").distinct().limit(2).collect():
        if problems := header_problems(r["fields"], columns, exact=True):
            raise BadFile(problems[0])
    if ragged := found.records.filter(F.size("fields") != len(columns)).orderBy("record").first():
        raise BadFile(f"RAGGED in record {ragged['record']}")
    return found.records.filter("record > 1").select(F.col("record").alias("_record"), *[F.col("fields")[i].alias(c) for i, c in enumerate(columns)])


def import_files(spark: SparkSession, path: str, block_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Import files as they would be taken one by one: a report of each, and their rows.

    report: file, size, code (why the file is rejected as a whole, or null), total (rows), ragged (rows of another length
    than the header). A ragged row rejects the file but not the rows after it; a quoting error ends it. rows: file, row (the
    record's number, the header being 1), values by header.
    """
    found = strict_csv.read(spark, path, block_bytes=block_bytes)
    # a header a file; records never meet them in a shuffle while files are few
    few = F.broadcast if found.files.count() <= strict_csv.BROADCAST_BLOCKS else lambda df: df.hint("merge")
    heads = few(found.records.filter("record = 1").select("file", F.col("fields").alias("header")))
    named = found.records.filter("record > 1").join(heads, "file").withColumn("same", F.size("fields") == F.size("header"))
    rows = found.files.join(heads, "file", "left").join(named.groupBy("file").agg(F.count_if(~F.col("same")).alias("n_ragged")), "file", "left")
    control = F.exists("header", lambda h: (text.trimmed(h) == "") | (text.trimmed(h) != h) | text.has_control(h))
    total = F.greatest(F.col("records") - 1, F.lit(0).cast("long"))
    refused = F.when((F.col("size") > IMPORT_BYTES) & (F.col("newlines") <= IMPORT_ROWS), "CSV_TOO_LARGE").when(~F.col("valid"), "CSV_INVALID_ENCODING").when(F.col("error_record") == 1, "CSV_MALFORMED")
    refused = refused.when(F.col("header").isNull(), "CSV_MISSING_HEADERS").when(control, "CSV_INVALID_HEADER").when(F.size(F.array_distinct("header")) < F.size("header"), "CSV_DUPLICATE_HEADERS")
    refused = refused.when(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "header")) > 0, "CSV_MISSING_HEADERS").when(total > IMPORT_ROWS, "CSV_TOO_MANY_ROWS")
    rows = rows.withColumn("refused", refused)
    code = F.coalesce("refused", F.when(F.col("error").isNotNull() | (F.col("n_ragged") > 0), "CSV_MALFORMED"))
    zero = lambda c: F.when(F.col("refused").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    report = rows.select("file", "size", code.alias("code"), zero(total).alias("total"), zero(F.col("n_ragged")).alias("ragged"), "refused")
    read = named.filter("same").join(few(report.filter("refused IS NULL").select("file")), "file", "left_semi")
    return report.drop("refused"), read.select("file", F.col("record").alias("row"), F.map_from_arrays("header", "fields").alias("values"))


def export_problems(rows: DataFrame, approved: Sequence[str] = ()) -> Column:
    """The rules an export row breaks, as an array of codes. approved: hosts of images besides those that the row lists."""
    c = F.col
    action, previous, target = c("action"), F.coalesce(c("previous_relative_path"), F.lit("")), c("target_relative_path")
    listed = F.from_json("image_origin_allowlist", "array<string>")
    host = r"^(?=.{1,253}\z)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z][a-z0-9-]*\z"
    exact = F.transform(listed, lambda h: F.lower(F.regexp_replace(h, r"\.\z", "")))
    address = lambda x: x.rlike(r"^(?i:https)://[^/?#\s@]+([/?#]\S*)?\z") & ~text.has_control(x)
    at = lambda x: F.regexp_replace(urls.host(F.regexp_replace(x, "^(?i:https)", "https")), r"(:443|\.)\z", "")
    image = lambda x: address(x) & (F.array_contains(exact, at(x)) | urls.host_allowed(at(x), approved))
    safe = lambda x: text.is_safe_path(x, FIELD_CHARS) & ~x.rlike('[<>"|?*]')
    said = lambda x: (text.trimmed(x) != "") & ~x.rlike(r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]")
    placed = lambda folder, of: target.rlike(SUFFIX + r"\z") & (F.regexp_replace(target, SUFFIX + r"\z", "") == F.concat_ws("/", F.lit(folder), of, c("candidate_id")))
    old = previous.rlike(r"^images/[^/]+/.*" + SUFFIX + r"\z")
    shape = F.when(action == "REMOVE", placed("_removed", c("batch_id")) & old).when(action == "MOVE", placed("images", c("species_code")) & old).otherwise(placed("images", c("species_code")) & ((previous == "") | old))
    rules = {
        "TOO_LONG": ~F.forall(F.array(*[c(x) for x in EXPORT]), lambda x: F.length(x) <= FIELD_CHARS),
        "BAD_ID": ~(c("batch_id").rlike(UUID) & c("candidate_id").rlike(UUID) & c("review_id").rlike(UUID)),
        "BAD_TOKEN": ~c("receipt_token").rlike(r"^[A-Za-z0-9_-]{20,512}\z"),
        "BAD_ACTION": ~action.isin("ADD", "MOVE", "REMOVE"),
        "BAD_HOSTS": ~(F.size(listed).between(1, 32) & F.forall(exact, lambda h: h.rlike(host))),
        "BAD_VERSION": ~(c("review_version").rlike(r"^[0-9]+\z") & (F.expr("try_cast(review_version AS BIGINT)") >= 1)),
        "BAD_CODE": ~text.is_safe_code(c("species_code")),
        "BAD_PATH": ~(safe(target) & ((previous == "") | safe(previous))),
        "BAD_URL": ~(image(c("preview_url")) & image(c("original_url")) & address(c("source_url")) & ((text.trimmed(c("license_url")) == "") | address(c("license_url")))),
        "BAD_TEXT": ~(said(c("license")) & said(c("attribution")) & ((text.trimmed(c("creator")) == "") | said(c("creator")))),
        "BAD_SHAPE": ~shape | ((action != "ADD") & (previous != "") & (text.casefold(previous) == text.casefold(target))),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for code, bad in rules.items()]), lambda x: x.isNotNull())


def load_export(spark: SparkSession, path: str, most_rows: int = EXPORT_ROWS, most_bytes: int = EXPORT_BYTES, approved: Sequence[str] = ()) -> DataFrame:
    """A valid export file, or BadFile: sound CSV, exact header, valid rows, one batch and token, unique operations and targets."""
    rows = strict_rows(spark, path, EXPORT, most_bytes)
    if bad := rows.withColumn("_problems", export_problems(rows, approved)).filter(F.size("_problems") > 0).orderBy("_record").first():
        raise BadFile(f"{bad['_problems'][0]} in record {bad['_record']}")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("batch_id") == F.max("batch_id"), F.min("receipt_token") == F.max("receipt_token")).first()
    if not 1 <= facts["n"] <= most_rows:
        raise BadFile("ROWS")
    if not (facts[1] and facts[2]):
        raise BadFile("MIXED_BATCH")
    for keys in (["candidate_id", "review_id", F.col("review_version").cast("bigint")], [text.casefold(F.col("target_relative_path"))]):
        if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise BadFile("REPEATED")
    return rows.drop("_record")


def _item_shape() -> Column:
    """What is wrong with the shape of a receipt's item."""
    done = F.col("status") == "SUCCEEDED"
    shape = F.when(done & (F.col("sha256").isNull() | F.col("relative_path").isNull() | F.col("error").isNotNull()), "BAD_SUCCESS")
    shape = shape.when(F.col("status") == "FAILED", F.when(F.col("error").isNull() | F.col("sha256").isNotNull() | F.col("relative_path").isNotNull(), "BAD_FAILURE")).when(~F.coalesce(done, F.lit(False)), "BAD_STATUS")
    return shape


def read_receipt(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, position and the fields of each receipt item, with what is wrong with its shape."""
    rows = spark.read.schema(RECEIPT).json(path, multiLine=True).select("batch_id", F.posexplode("items").alias("position", "item")).select("batch_id", "position", "item.*")
    return rows.withColumn("problem", _item_shape())


#: Limits of a receipt's body.
RECEIPT_BYTES, RECEIPT_ITEMS, RECEIPT_DEPTH = 20 * 1024 * 1024, 10_000, 8


def receipt_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Receipt files as they would be taken one by one: a report of each, and the items of sound ones.

    report: file, size, sha256 (null if too large), problem (BODY_TOO_LARGE, BAD_ENCODING, TOO_DEEP, BAD_JSON, UNKNOWN_KEY,
    TOO_MANY_ITEMS or null), n_items. A file that is too large is never read, one that is too deep is never parsed. items:
    file, batch_id, position, the item's fields, problem of its shape.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), "content")
    large = files.filter(F.col("size") > RECEIPT_BYTES).select("file", "size")
    body = F.regexp_replace(F.try_validate_utf8("content"), "^\ufeff", "")
    rows = files.filter(F.col("size") <= RECEIPT_BYTES).select("file", "size", F.sha2("content", 256).alias("sha256"), body.alias("body"))
    rows = rows.withColumn("deep", canonical_json.depth(F.coalesce("body", F.lit(""))) > RECEIPT_DEPTH)
    keys = F.json_object_keys(F.when(~F.col("deep"), F.col("body")))
    rows = rows.withColumns({"keys": keys, "receipt": F.from_json(F.when(~F.col("deep"), F.col("body")), RECEIPT, {"mode": "PERMISSIVE"}), "raw": F.from_json(F.when(~F.col("deep"), F.col("body")), "items array<map<string,string>>")})
    known = [f.name for f in RECEIPT["items"].dataType.elementType.fields]
    unknown = (F.size(F.array_except("keys", F.array(F.lit("batch_id"), F.lit("items")))) > 0) | F.exists("raw.items", lambda x: F.size(F.array_except(F.map_keys(x), F.array(*map(F.lit, known)))) > 0)
    problem = F.when(F.col("body").isNull(), "BAD_ENCODING").when(F.col("deep"), "TOO_DEEP").when(F.col("keys").isNull() | F.col("receipt.items").isNull() | F.col("receipt.batch_id").isNull(), "BAD_JSON").when(F.coalesce(unknown, F.lit(False)), "UNKNOWN_KEY").when(F.size("receipt.items") > RECEIPT_ITEMS, "TOO_MANY_ITEMS")
    judged = rows.select("file", "size", "sha256", problem.alias("problem"), F.when(problem.isNull(), F.size("receipt.items")).cast("long").alias("n_items"), "receipt")
    report = judged.drop("receipt").unionByName(large.select("file", "size", F.lit(None).cast("string").alias("sha256"), F.lit("BODY_TOO_LARGE").alias("problem"), F.lit(None).cast("long").alias("n_items")))
    items = judged.filter("problem IS NULL").select("file", "receipt.batch_id", F.posexplode("receipt.items").alias("position", "item")).select("file", "batch_id", "position", "item.*")
    return report, items.withColumn("problem", _item_shape())


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row a category, with defaults for the source filters; BadFile for another schema version or repeated codes."""
    raw = spark.read.schema(CONFIG).json(path, multiLine=True)
    if raw.filter("schema_version = 2").isEmpty():
        raise BadFile("SCHEMA_VERSION")
    rows = raw.select(F.inline("species"))
    if not rows.groupBy("seafood_code").count().filter("count > 1").isEmpty():
        raise BadFile("REPEATED")
    return rows.withColumn("commons_category", F.coalesce("commons_category", F.concat(F.lit("Category:"), F.col("scientific_name")))).withColumn("fish_vista_filter", F.coalesce("fish_vista_filter", "scientific_name"))


def receipt_json(items: DataFrame) -> DataFrame:
    """One JSON text a batch, items in order of position."""
    item = F.struct("position", "candidate_id", "review_id", "review_version", "status", "sha256", "relative_path", "error")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("position"))
    return items.groupBy("batch_id").agg(ordered.alias("items")).select(F.to_json(F.struct("batch_id", "items")).alias("value"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], max_rows: int = 1_000_000) -> None:
    """A folder of CSV files, nulls as '', each of at most ``max_rows`` rows; the commit makes it appear as a whole."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("maxRecordsPerFile", max_rows).csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_export(rows: DataFrame, path: str) -> None:
    """An export (EXPORT columns) in order of species and item, as ordered parts."""
    ordered_csv.write(rows, path, EXPORT, ["species_code", "candidate_id", "review_version"])


def write_manifest(rows: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """The 30 manifest columns of ``rows`` ('' for those that they lack), other columns left out, in place of what is there."""
    whole = rows.select("*", *[F.lit("").alias(c) for c in MANIFEST if c not in rows.columns])
    ordered_csv.write(whole, path, MANIFEST, order, overwrite=True)


def write_full_manifest(items: DataFrame, path: str, id_column: str) -> None:
    """Every item as a row still to be reviewed, by the categories' order and code, source and id.

    items: ``id_column``, sort_order, code, and as far as they have them the manifest's columns.
    """
    review = {"image_context": "REVIEW", "whole_fish": "REVIEW", "exact_species_verified": "REVIEW", "split": "UNASSIGNED", "status": "CANDIDATE"}
    rows = items.withColumns({"image_id": F.col(id_column), "seafood_code": F.col("code")} | {k: F.lit(x) for k, x in review.items()})
    write_manifest(rows, path, ["sort_order", "code", "source_dataset", id_column])


def append_log(df: DataFrame, path: str) -> None:
    """Operations appended as JSON lines."""
    df.write.mode("append").json(path)


def canonical_problems(rows: DataFrame) -> Column:
    """The rules a canonical row breaks, as an array of codes."""
    path = F.col("relative_path")
    rules = {
        "BAD_ID": ~(F.col("candidate_id").rlike(UUID) & F.col("review_id").rlike(UUID)),
        "BAD_VERSION": F.coalesce(F.expr("try_cast(review_version AS BIGINT)"), F.lit(0)) < 1,
        "BAD_PATH": ~(text.is_safe_path(path) & path.startswith("images/")),
        "BAD_HASH": ~F.col("sha256").rlike(r"^[0-9a-f]{64}\z"),
    }
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), code) for code, bad in rules.items()]), lambda x: x.isNotNull())


def read_canonical(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """A valid canonical manifest, or BadFile: sound CSV, exact header, valid rows, unique items, paths unique in any case."""
    rows = strict_rows(spark, path, CANONICAL, most_bytes)
    if bad := rows.withColumn("_problems", canonical_problems(rows)).filter(F.size("_problems") > 0).orderBy("_record").first():
        raise BadFile(f"{bad['_problems'][0]} in record {bad['_record']}")
    for key in (F.col("candidate_id"), text.casefold(F.col("relative_path"))):
        if not rows.groupBy(key.alias("_key")).count().filter("count > 1").isEmpty():
            raise BadFile("REPEATED")
    return rows.drop("_record")


def write_canonical(rows: DataFrame, path: str) -> None:
    """A folder of CSV files whose names and rows follow the order of candidate_id: range partitions, each sorted by itself."""
    write_csv(rows.select(*CANONICAL).orderBy("candidate_id"), path, CANONICAL)


def chunks(rows: DataFrame, size: int = 250) -> Iterator[list[Row]]:
    """Rows in their order, ``size`` at a time; the driver holds a partition and the one after it."""
    it = rows.toLocalIterator(prefetchPartitions=True)
    while some := list(islice(it, size)):
        yield some


def config_json(categories: DataFrame, version: int = 2) -> DataFrame:
    """One JSON text: the collector's configuration of the categories (fields of CONFIG), by code. One row a category, so few."""
    entry = F.struct(*CONFIG_FIELDS)
    return categories.agg(F.array_sort(F.collect_list(entry)).alias("species")).select(F.to_json(F.struct(F.lit(version).alias("schema_version"), "species")).alias("value"))
