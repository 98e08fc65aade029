"""Imports: rows brought to one form with their first problem, the preview of an import, and its commit.

``normalise`` judges each row by itself in one projection, without a shuffle; ``classify`` then compares the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import hosts, rules, text, urls

#: Fields of an import file with the characters each may have.
FIELDS = {
    "seafood_code": 32,
    "source_dataset": 128,
    "source_record_id": 255,
    "source_url": 2048,
    "image_url": 2048,
    "creator": 512,
    "license": 255,
    "license_url": 2048,
    "attribution": 1024,
    "source_location": 512,
    "source_date": 512,
}
#: Sources that may be imported.
SOURCES = ("ATLAS_OF_LIVING_AUSTRALIA", "FISH_VISTA", "GBIF", "INATURALIST", "NOAA_PHOTO_LIBRARY", "OBIS", "SMITHSONIAN_OPEN_ACCESS", "WIKIMEDIA_COMMONS")
#: Other known fields, about local files and reviews; they are dropped.
LOCAL_FIELDS = ("local_path", "sha256", "perceptual_hash", "split", "status", "rejection_reason", "whole_fish", "exact_species_verified", "verified_by", "verification_notes")
URL_CHARS = 2048
METADATA_BYTES = 65_536
_SIZED = r"(?i)/(?:square|small|medium|large|original)\.([a-z0-9]{1,10})\z"


def _problem(code: str | Column, counter: str, host: Column | None = None) -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(counter).alias("counter"), (F.lit(None).cast("string") if host is None else host).alias("host"))


def _address(c: Column) -> Column:
    """The address in one form, or null if it is not fit for use."""
    return hosts.normalized(c)


def _address_problem(raw: Column, address: Column) -> Column:
    code = F.when(text.has_control(raw), "INVALID_CONTROL_CHARACTER").when(raw.rlike(r"(?U)\s"), "UNSAFE_URL").when(raw == "", "MISSING_URL").when(address.isNull(), "UNSAFE_URL")
    return F.when(code.isNotNull(), _problem(code, "missing_urls"))


def _sized(address: Column, size: str) -> Column:
    """A photo's address with another size, without a fragment."""
    path = urls.path(address)
    asked = urls.query(address)
    suffix = F.lower(F.regexp_extract(path, _SIZED, 1))
    return F.concat(F.lit("https://"), urls.host(address), F.regexp_replace(path, _SIZED, ""), F.lit(f"/{size}."), suffix, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def _metadata(extra: Column) -> Column:
    """What an import keeps of unknown fields: no paths, hashes, downloads or reviews, nothing blank; the last of equal keys."""
    known = [*FIELDS, *LOCAL_FIELDS]
    low = lambda k: F.lower(k)
    local = lambda k: low(k).rlike("path|hash|^download|^review|_review$")
    entries = F.transform(F.map_entries(extra), lambda e: F.struct(text.trimmed(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(entries, lambda e: ~low(e["key"]).isin(*known) & ~local(e["key"]) & (F.coalesce(text.human(e["value"]), F.lit("?")) != "") & e["value"].isNotNull())
    return F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))


def _json_bytes(m: Column) -> Column:
    """Bytes of a map as JSON with a space after each comma and colon."""
    return F.octet_length(F.to_json(m)) + F.greatest(F.lit(0), 2 * F.size(m) - 1)


def _settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out here: a later filter or projection refers to them and doesn't repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def normalise(rows: DataFrame, allowed_hosts: Sequence[str]) -> DataFrame:
    """row, problem, counter, host and the row's values in one form; values are null where there is a problem.

    rows: row, FIELDS as text (null: empty), and optionally extra, a map of the other fields. problem is the first that
    holds in the order of the checks; counter is the count of the report it belongs to; host is set for unapproved ones.
    warning tells of a date that couldn't be read, which is kept in metadata.
    """
    raw = rows.select("row", *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in FIELDS], (F.col("extra") if "extra" in rows.columns else F.lit(None)).cast("map<string,string>").alias("extra"))
    raw = raw.withColumns({f: text.trimmed(F.col(f)) for f in ("source_url", "image_url", "license_url")} | {"_long": F.exists(F.array(*[F.length(f) > n for f, n in FIELDS.items()]), lambda x: x)})
    raw = _settled(raw)
    code, source, record = (text.identifier(F.col(f)) for f in ("seafood_code", "source_dataset", "source_record_id"))
    step = raw.withColumns(
        {
            "_code": code, "_source": F.upper(source), "_record": record, "_page": _address(F.col("source_url")), "_image": _address(F.col("image_url")),
            "_terms": F.when(F.col("license_url").rlike("^(?i:https?)://"), _address(F.col("license_url"))), "_licence": rules.import_licence(F.col("license")),
            "_creator": text.human(F.col("creator")), "_given": text.human(F.col("attribution")), "_place": text.human(F.col("source_location")), "_said": text.human(F.col("source_date")),
            "_entries": F.coalesce(_metadata(F.col("extra")), F.expr("array()").cast("array<struct<key:string,value:string>>")),
        }
    )
    step = _settled(step)
    sized = urls.host("_image").contains("inaturalist") & urls.path("_image").rlike(_SIZED)
    c = F.col
    step = step.withColumns({"_sized": sized, "_day": text.source_date(c("_said"))}).withColumns(
        {
            "_preview": F.when(c("_source").isin("INATURALIST", "GBIF") & c("_sized"), _sized(c("_image"), "large")).when(c("_source") == "WIKIMEDIA_COMMONS", urls.without_tracking("_image")).otherwise(c("_image")),
            "_original": F.when(c("_source").isin("INATURALIST", "GBIF") & c("_sized"), _sized(c("_image"), "original")).when(c("_source") == "WIKIMEDIA_COMMONS", urls.without_tracking("_image")).otherwise(c("_image")),
            "_undated": (c("_said") != "") & c("_day").isNull(),
        }
    )
    step = _settled(step)
    host = F.regexp_replace(urls.host("_preview"), r":\d+$|\.+$", "")
    changed = F.filter(
        F.array(
            F.when(c("source_url") != c("_page"), F.struct(F.lit("source_url").alias("key"), c("source_url").alias("value"))),
            F.when(~c("image_url").isin(c("_preview"), c("_original")), F.struct(F.lit("image_url").alias("key"), c("image_url").alias("value"))),
            F.when(c("license_url") != c("_terms"), F.struct(F.lit("license_url").alias("key"), c("license_url").alias("value"))),
        ),
        lambda e: e.isNotNull(),
    )
    values = F.transform(c("_entries"), lambda e: F.struct(e["key"].alias("key"), text.human(e["value"]).alias("value")))
    undated = F.when(c("_undated"), F.array(F.struct(F.lit("raw_source_date").alias("key"), c("_said").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    others = F.filter(values, lambda e: ~c("_undated") | (e["key"] != "raw_source_date"))
    step = step.withColumns({"_host": host, "_raw": F.map_from_entries(changed), "_metadata": F.map_from_entries(F.concat(others, undated))})
    step = _settled(step)
    nested = F.when(F.size("_raw") > 0, _json_bytes(c("_raw")) + 12 + F.when(F.size("_metadata") > 0, 2).otherwise(0)).otherwise(0)
    control = lambda x: F.when(x, _problem("INVALID_CONTROL_CHARACTER", "parse_errors"))
    checks = [
        F.when(c("_long"), _problem("FIELD_TOO_LONG", "parse_errors")),
        control(c("_code").isNull()),
        F.when(~text.is_safe_code(c("_code")), _problem("INVALID_SPECIES", "invalid_species")),
        control(c("_source").isNull()),
        F.when(~c("_source").isin(*SOURCES), _problem("UNSUPPORTED_SOURCE", "invalid_sources")),
        control(c("_record").isNull()),
        F.when(c("_record") == "", _problem("MISSING_SOURCE_IDENTITY", "parse_errors")),
        _address_problem(c("source_url"), c("_page")),
        _address_problem(c("image_url"), c("_image")),
        F.when(c("license_url").rlike("^(?i:https?)://") & c("_terms").isNull(), _problem("INVALID_LICENSE_URL", "invalid_licenses")),
        F.when((c("_source") == "INATURALIST") & ~c("_sized"), _problem("UNSAFE_URL", "missing_urls")),
        F.when(urls.host("_preview").rlike(r":(?!443$)\d+$"), _problem("UNSAFE_URL", "missing_urls")),
        F.when(~urls.host_allowed(c("_host"), allowed_hosts), _problem("UNAPPROVED_IMAGE_HOST", "missing_urls", c("_host"))),
        control(c("_creator").isNull() | text.has_control(c("license"))),
        F.when(c("_licence").isNull(), _problem("INVALID_LICENSE", "invalid_licenses")),
        control(c("_given").isNull() | c("_place").isNull() | F.coalesce(F.exists(F.map_keys("extra"), text.has_control), F.lit(False)) | F.exists(values, lambda e: e["value"].isNull()) | c("_said").isNull()),
        F.when(F.exists(F.array("_preview", "_original", "_page", "_terms"), lambda u: F.coalesce(F.length(u) > URL_CHARS, F.lit(False))), _problem("FIELD_TOO_LONG", "parse_errors")),
        F.when(_json_bytes(c("_metadata")) + nested > METADATA_BYTES, _problem("METADATA_TOO_LARGE", "parse_errors")),
    ]
    judged = _settled(step.withColumn("_problem", F.coalesce(*checks)))
    fine = c("_problem").isNull()
    out = {
        "category": c("_code"), "source": c("_source"), "record_id": c("_record"), "preview_url": c("_preview"), "original_url": c("_original"), "source_url": c("_page"),
        "creator": F.nullif(c("_creator"), F.lit("")), "license": c("_licence"), "license_url": c("_terms"), "attribution": rules.attribution(c("_given"), c("_creator"), c("_source"), c("_record")),
        "location": F.nullif(c("_place"), F.lit("")), "observed_on": c("_day"), "metadata": c("_metadata"), "raw_urls": c("_raw"), "warning": F.when(c("_undated"), "UNPARSED_SOURCE_DATE"),
    }
    return judged.select("row", c("_problem.code").alias("problem"), c("_problem.counter").alias("counter"), c("_problem.host").alias("host"), *[F.when(fine, v).alias(k) for k, v in out.items()])


def fingerprint(state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: fingerprint, equal for equal rows in any order. Sums of hashes, folded before the shuffle."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return state.agg(F.concat_ws(":", n.cast("string"), total.cast("string")).alias("fingerprint"))


def preview(classified: DataFrame, state: DataFrame, blocking: Sequence[str]) -> DataFrame:
    """One row: counts by outcome, whether the import can be committed, and the fingerprint of the state it was judged by.

    classified: row, outcome. state: identity, material.
    """
    count = lambda which, name: F.count_if(which).alias(name)
    o = F.col("outcome")
    said = classified.agg(
        F.count(F.lit(1)).alias("total"), count(o == "NEW", "new"), count(o == "EXACT_DUPLICATE", "exact"), count(o == "DUPLICATE_IMAGE_URL", "same_url"), count(o.isin(*blocking), "blocked")
    )
    return said.withColumn("can_commit", (F.col("blocked") == 0) & (F.col("total") > 0)).join(fingerprint(state, ["identity", "material"]), F.lit(True))


def commit(previewed: DataFrame, current: DataFrame, skip_blocking: bool = False) -> DataFrame:
    """One row: status and what the commit of a previewed import does, given the preview that holds now.

    IMPORT_PREVIEW_BLOCKED comes before IMPORT_PREVIEW_STALE (any difference) and IMPORT_NO_VALID_ROWS; counts are zero
    unless COMMITTED.
    """
    names = previewed.columns
    both = current.join(previewed.select([F.col(c).alias(f"_{c}") for c in names]), F.lit(True))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(~F.col("_can_commit") & ~F.lit(skip_blocking), "IMPORT_PREVIEW_BLOCKED").when(~same, "IMPORT_PREVIEW_STALE").when(F.lit(skip_blocking) & (F.col("new") == 0), "IMPORT_NO_VALID_ROWS").otherwise("COMMITTED")
    done = lambda c, name: F.when(F.col("status") == "COMMITTED", c).otherwise(F.lit(0).cast("long")).alias(name)
    skipped = F.col("blocked") if skip_blocking else F.lit(0).cast("long")
    return both.withColumn("status", status).select("status", "total", done(F.col("new"), "inserted"), done(F.col("exact"), "skipped_exact"), done(F.col("same_url"), "skipped_url_duplicates"), done(skipped, "skipped_blocking"))


def inserted(rows: DataFrame, classified: DataFrame, result: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows a commit appends, as version 1 and active: NEW ones, none unless it went through, none that is stored already."""
    new = classified.filter("outcome = 'NEW'").select("row")
    went = result.filter("status = 'COMMITTED'").select("status")
    return rows.join(new, "row", "left_semi").join(F.broadcast(went), F.lit(True), "left_semi").join(stored.select("identity"), "identity", "left_anti").withColumns({"version": F.lit(1), "active": F.lit(True)})


def approve_hosts(requested: DataFrame, normalised: DataFrame, approved: DataFrame) -> DataFrame:
    """host, outcome of requested hosts: NOT_IN_PREVIEW unless the import has rows with the host, else ALREADY_APPROVED or APPROVED."""
    asked = requested.select(F.lower(F.regexp_replace(F.trim("host"), r"\.+$", "")).alias("host")).distinct()
    seen = normalised.filter("problem = 'UNAPPROVED_IMAGE_HOST'").select("host").distinct().withColumn("_seen", F.lit(True))
    old = approved.select("host").distinct().withColumn("_old", F.lit(True))
    outcome = F.when(F.col("_old"), "ALREADY_APPROVED").when(F.col("_seen"), "APPROVED").otherwise("NOT_IN_PREVIEW")
    return asked.join(seen, "host", "left").join(old, "host", "left").select("host", outcome.alias("outcome"))


def purge(previews: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """previews without the ``most`` that expired first (preview_id, expires_at)."""
    gone = previews.filter(F.col("expires_at") <= now).orderBy("expires_at", "preview_id").limit(most).select("preview_id")
    return previews.join(F.broadcast(gone), "preview_id", "left_anti")
