"""Registered queries over files that Spark writes from the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.plans import views as v
from siltstone.plans.catalogue import query
from siltstone.sources import manifests, ordered_csv, parsers, scratch, strict_csv

#: Documents in a file.
FILE_ROWS = 200
_COLUMNS = (*manifests.REQUIRED, "attribution")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """Documents with their file, place in it, and whether they are the first there with a length of 3 modulo 7."""
    by = Window.partitionBy("file").orderBy("doc_id")
    docs = v.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.upper(F.coalesce("lang", F.lit(""))).alias("code"), F.expr(f"doc_id div {FILE_ROWS}").alias("file"))
    # one shuffle for the windows and the files; with a number, as Spark may deal a repartition without one anew
    docs = docs.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "file").withColumn("n", F.row_number().over(by))
    return docs.withColumn("bad", F.coalesce(F.col("n") == F.min(F.when(F.length("text") % 7 == 3, F.col("n"))).over(Window.partitionBy("file")), F.lit(False)))


def _written(s: SparkSession, rows: DataFrame, name: str, head: Column | None = None) -> str:
    """A folder with the lines of each file (file, n, line; a file in one task) in a file of their own, ended by CRLF; ``head`` comes before the line of n = 1."""
    path = scratch.folder(s, name)
    lines = F.array("line") if head is None else F.when(F.col("n") == 1, F.array(head, F.col("line"))).otherwise(F.array("line"))
    rows.sortWithinPartitions("file", "n").select("file", F.explode(lines).alias("line")).select("file", F.concat("line", F.lit("\r")).alias("line")).write.partitionBy("file").text(path)
    return path


def _file(c: str = "file") -> Column:
    return F.regexp_extract(c, r"file=(\d+)", 1).cast("bigint")


_FILED = f"""docs AS (SELECT doc_id, coalesce(text, '') AS t, upper(coalesce(lang, '')) AS code, doc_id // {FILE_ROWS} AS file, row_number() OVER (PARTITION BY doc_id // {FILE_ROWS} ORDER BY doc_id) AS n FROM documents),
    placed AS (SELECT *, min(CASE WHEN length(t) % 7 = 3 THEN n END) OVER (PARTITION BY file) AS bad, min(CASE WHEN length(t) > 131072 THEN n END) OVER (PARTITION BY file) AS long FROM docs)"""


@query(f"""WITH {_FILED}, stops AS (SELECT *, CASE WHEN file % 5 IN (2, 4) THEN least(coalesce(bad, long), coalesce(long, bad)) ELSE long END AS stop FROM placed),
    reports AS (SELECT file, CASE WHEN file % 5 = 3 THEN 'CSV_MISSING_HEADERS' WHEN max(stop) IS NOT NULL OR file % 5 = 1 AND count(*) FILTER (length(t) % 11 = 0 AND (stop IS NULL OR n < stop)) > 0 THEN 'CSV_MALFORMED' END AS file_code,
        CASE WHEN file % 5 = 3 THEN 0 ELSE count(*) FILTER (stop IS NULL OR n < stop) END AS total, CASE WHEN file % 5 = 1 THEN count(*) FILTER (length(t) % 11 = 0 AND (stop IS NULL OR n < stop)) ELSE 0 END AS ragged FROM stops GROUP BY file)
    SELECT file, file_code, total, ragged, n + 1 AS row, 'r' || CAST(doc_id AS VARCHAR) AS record_id, code, sha256(t) AS text_sha256 FROM reports LEFT JOIN (SELECT * FROM stops WHERE file % 5 <> 3 AND (stop IS NULL OR n < stop) AND NOT (file % 5 = 1 AND length(t) % 11 = 0)) USING (file)""")
def import_files(s: SparkSession, d: str) -> DataFrame:
    """Import files of documents: sound ones, and ones with ragged rows, text after a quote, a missing header or an open quote."""
    rows = _numbered(s, d)
    kind = F.col("file") % 5
    text = F.when((kind == 4) & F.col("bad"), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')))).otherwise(_quoted(F.col("text")))
    text = F.concat(text, F.when((kind == 2) & F.col("bad"), "x").otherwise(""), F.when((kind == 1) & (F.length("text") % 11 == 0), ",more").otherwise(""))
    line = F.concat_ws(",", _quoted(F.col("code")), F.lit("GBIF"), F.concat(F.lit("r"), F.col("doc_id").cast("string")), F.lit("https://a.org/1"), F.lit('"https://a.org/1.jpg"'), F.lit("CC0"), text)
    head = F.when(kind == 3, ",".join(c if c != "license" else "licence" for c in _COLUMNS)).otherwise(",".join(_COLUMNS))
    path = _written(s, rows.select("file", "n", line.alias("line")), "import-files", head)
    report, read = manifests.import_files(s, path)
    read = read.select("file", "row", F.col("values")["source_record_id"].alias("record_id"), F.col("values")["seafood_code"].alias("code"), F.sha2(F.col("values")["attribution"], 256).alias("text_sha256"))
    return report.join(read, "file", "left").select(_file().alias("file"), report["code"].alias("file_code"), "total", "ragged", "row", "record_id", read["code"].alias("code"), "text_sha256")


@query(f"""WITH {_FILED}, ends AS (SELECT file, count(*) AS n, CASE WHEN file % 5 = 0 THEN NULL ELSE min(bad) END AS bad, min(long) AS long FROM placed GROUP BY file)
    SELECT file, CASE WHEN bad IS NULL AND long IS NULL THEN n ELSE least(coalesce(bad, long), coalesce(long, bad)) - 1 END AS records, CASE WHEN long IS NOT NULL AND long <= coalesce(bad, long) THEN 'LONG_FIELD' WHEN bad IS NULL THEN NULL WHEN file % 5 = 1 THEN 'QUOTE_IN_FIELD' WHEN file % 5 = 2 THEN 'BARE_CR' WHEN file % 5 = 4 AND bad = n THEN 'OPEN_QUOTE' ELSE 'AFTER_QUOTE' END AS error,
        least(coalesce(bad, long), coalesce(long, bad)) AS error_record FROM ends""")
def strict_files(s: SparkSession, d: str) -> DataFrame:
    """Files of documents judged by the strict rules: sound ones, and ones with a quote or a bare CR in a field, or a quote that doesn't end where it should."""
    rows = _numbered(s, d)
    kind, bad, doc = F.col("file") % 5, F.col("bad"), F.col("doc_id").cast("string")
    tail = F.when(bad & (kind == 1), 'a"b').when(bad & (kind == 2), "a\rb").when(bad & (kind == 3), '"a" b').when(bad & (kind == 4), '"a').otherwise("a")
    # fields begin with a quote and a digit, so that an open quote is seen at the next line's begin
    line = F.concat_ws(",", F.concat(F.lit('"'), doc, F.lit('"')), _quoted(F.col("text")), tail)
    path = _written(s, rows.select("file", "n", line.alias("line")), "strict-files")
    found = strict_csv.read(s, path, strict_csv.Dialect(rfc=True))
    return found.files.select(_file().alias("file"), "records", "error", "error_record")


@query("""SELECT row_number() OVER (ORDER BY coalesce(lang, ''), coalesce(source, ''), doc_id) AS place, doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def ordered_export(s: SparkSession, d: str) -> DataFrame:
    """Documents exported in order, and where the joined parts have them."""
    path = scratch.folder(s, "export")
    rows = v.table(s, d, "documents").select("doc_id", "text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    ordered_csv.write(rows, path, ["doc_id", "lang", "source", "text"], ["lang", "source", "doc_id"])
    found = strict_csv.read(s, path, strict_csv.Dialect(rfc=True, field_chars=1 << 30))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.files.select("file", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("before"))  # a row a part
    placed = found.records.join(parts, "file").withColumn("place", F.col("before") + F.col("record") - 1).filter("place > 0")
    return placed.select("place", F.col("fields")[0].cast("long").alias("doc_id"), F.sha2(F.col("fields")[3], 256).alias("text_sha256"))


_ITEM = """'{"candidate_id":"c' || CAST(doc_id AS STRING) || '","review_id":null,"review_version":' || CAST(doc_id AS STRING) || ',"status":"' || CASE WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END || '","sha256":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"x"' END || ',"relative_path":' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '"p [{"' END || ',"error":' || CASE WHEN doc_id % 5 = 0 THEN '"[[[[[[[[["' ELSE 'null' END || CASE WHEN doc_id % 200 = 7 AND doc_id // 200 % 4 = 1 THEN ',"more":1' WHEN doc_id % 200 = 7 AND doc_id // 200 % 4 = 2 THEN ',"more":[[[[[[1]]]]]]' ELSE '' END || '}'"""
_BODY = f"""SELECT doc_id // 200 AS file, '{{"batch_id":"b' || CAST(doc_id // 200 AS STRING) || '","items":[' || string_agg({_ITEM}, ',' ORDER BY doc_id) || CASE WHEN doc_id // 200 % 4 = 3 THEN '' ELSE ']}}' END AS body, count(*) AS n, bool_or(doc_id % 200 = 7) AS odd FROM documents GROUP BY doc_id // 200"""
_SHAPE = "CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'BAD_SUCCESS' END ELSE CASE WHEN doc_id % 5 > 0 OR doc_id % 4 > 0 THEN 'BAD_FAILURE' END END"


@query(f"""WITH bodies AS ({_BODY}), judged AS (SELECT file, CASE WHEN file % 4 = 3 THEN 'BAD_JSON' WHEN file % 4 = 1 AND odd THEN 'UNKNOWN_KEY' WHEN file % 4 = 2 AND odd THEN 'TOO_DEEP' END AS file_problem, strlen(body) + 1 AS size, sha256(body || chr(10)) AS sha256, n FROM bodies)
    SELECT file, CAST(size AS BIGINT) AS size, sha256, file_problem, CASE WHEN file_problem IS NULL THEN n END AS n_items, CASE WHEN file_problem IS NULL THEN 'c' || CAST(doc_id AS VARCHAR) END AS candidate_id, CASE WHEN file_problem IS NULL THEN {_SHAPE} END AS problem FROM judged LEFT JOIN (SELECT doc_id, doc_id // 200 AS file FROM documents) USING (file) WHERE file_problem IS NULL
    UNION ALL SELECT file, size, sha256, file_problem, NULL, NULL, NULL FROM judged WHERE file_problem IS NOT NULL""")
def receipt_files(s: SparkSession, d: str) -> DataFrame:
    """Receipt files of documents: sound ones, and ones with an unknown key, too deep a value or an open end."""
    file = F.expr("doc_id div 200")
    docs = v.table(s, d, "documents").select("doc_id", file.alias("file"), F.expr(_ITEM.replace("doc_id // 200", "(doc_id div 200)")).alias("item"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), ",")
    body = F.concat(F.lit('{"batch_id":"b'), F.col("file").cast("string"), F.lit('","items":['), F.col("items"), F.when(F.col("file") % 4 == 3, "").otherwise("]}"))
    rows = docs.groupBy("file").agg(items.alias("items")).select("file", body.alias("body"))
    path = scratch.folder(s, "receipts")
    rows.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "file").select("file", "body").write.partitionBy("file").text(path)
    report, items = manifests.receipt_files(s, path)
    items = items.select("file", "candidate_id", F.col("problem").alias("item_problem"))
    joined = report.join(items, "file", "left")
    return joined.select(_file().alias("file"), "size", "sha256", F.col("problem").alias("file_problem"), "n_items", "candidate_id", F.col("item_problem").alias("problem"))


_CAPTURED = """'{"key":' || CAST(doc_id AS STRING) || ',"species":"' || CASE doc_id % 3 WHEN 0 THEN 'GADUS  morhua L.' ELSE 'Other' END || '","country":"' || CASE WHEN doc_id % 2 = 0 THEN 'NO' ELSE '' END || '","countryCode":"CC","eventDate":"2020","media":[{"identifier":"https://a.org/' || CAST(doc_id AS STRING) || '.jpg","license":"' || CASE doc_id % 4 WHEN 0 THEN 'cc-by' WHEN 1 THEN 'all rights' ELSE 'CC0' END || '","title":"' || sha256 || '"},{"type":"Sound","identifier":"s","license":"cc0"},{"type":"StillImage","references":"https://b.org","license":"CC0"}]}'"""


@query(f"""WITH captured AS (SELECT doc_id, {_CAPTURED} AS record FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents)),
    photos AS (SELECT doc_id, 'occ:' || doc_id || '/media:https://a.org/' || doc_id || '.jpg' AS source_record_id, 'https://a.org/' || doc_id || '.jpg' AS image_url, CASE WHEN doc_id % 4 = 0 THEN 'CC-BY' ELSE 'CC0' END AS license, CASE WHEN doc_id % 4 = 0 THEN 'cc-by' ELSE 'CC0' END AS license_url, record[strpos(record, '"title":"') + 9:strpos(record, '"title":"') + 72] AS attribution FROM captured WHERE doc_id % 4 <> 1
        UNION ALL SELECT doc_id, 'occ:' || doc_id || '/media:2', 'https://b.org', 'CC0', 'CC0', '' FROM captured)
    SELECT 'COD-' || substr(sha256('COD|GBIF|' || source_record_id), 1, 16) AS image_id, source_record_id, CASE WHEN doc_id % 3 = 0 THEN 'EXACT' ELSE 'QUERY_TAXON' END AS source_taxon_match, 'https://www.gbif.org/occurrence/' || doc_id AS source_url, image_url, license, license_url, attribution, CASE WHEN doc_id % 2 = 0 THEN 'NO' ELSE 'CC' END AS source_country, 'GBIF-OCC-' || doc_id AS original_group_id, 'CANDIDATE' AS status FROM photos""")
def captured_occurrences(s: SparkSession, d: str) -> DataFrame:
    """Manifest rows of records of one source, one a document."""
    docs = v.table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    records = docs.select(F.from_json(F.expr(_CAPTURED), parsers.GBIF).alias("r")).select("r.*")
    rows = parsers.gbif(records, "COD", "Gadus morhua", "Cod")
    return rows.select("image_id", "source_record_id", "source_taxon_match", "source_url", "image_url", "license", "license_url", "attribution", "source_country", "original_group_id", "status")
