"""Captured pages of item sources to manifest rows: one record gives none or many rows, all by array expressions.

Each parser takes a DataFrame with one nested record a row and gives the columns of ``ROW``; rows without an allowed
licence or of another name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.sources.manifests import MANIFEST

#: A candidate's manifest row, all 30 columns.
ROW = MANIFEST
#: What a row says before its review.
_REVIEW = {"image_context": "REVIEW", "whole_fish": "REVIEW", "exact_species_verified": "REVIEW", "split": "UNASSIGNED", "status": "CANDIDATE"}

INAT = "id bigint, uri string, taxon struct<name:string>, quality_grade string, place_guess string, observed_on string, time_observed_at string, user struct<login:string>, photos array<struct<id:bigint,url:string,license_code:string,license:string,attribution:string>>"
GBIF = "key bigint, references string, species string, acceptedScientificName string, scientificName string, basisOfRecord string, country string, countryCode string, locality string, stateProvince string, eventDate string, year string, media array<struct<type:string,identifier:string,references:string,license:string,creator:string,title:string,description:string>>"
COMMONS = "pageid bigint, title string, imageinfo array<struct<mime:string,url:string,descriptionurl:string,extmetadata:map<string,struct<value:string>>>>"
ALA = "uuid string, id string, scientificName string, license string, images array<string>, imageUrl string, references string, recordedBy string, identificationVerificationStatus string, basisOfRecord string, country string, locality string, stateProvince string, eventDate string"
OBIS = "id string, occurrenceID string, scientificName string, license string, associatedMedia string, references string, recordedBy string, basisOfRecord string, country string, locality string, eventDate string"
SMITHSONIAN = "id string, content struct<indexedStructured:struct<scientific_name:array<string>>,descriptiveNonRepeating:struct<record_link:string,data_source:string,online_media:struct<media:array<struct<type:string,guid:string,content:string,usage:struct<access:string>>>>>>"
VISTA = "standardized_species string, species string, license string, file_name string, original_url string, arkid string, source_filename string, owner string, source string, filename string, source_split string"


def name_key(c: Column) -> Column:
    """A name as it is compared: white space collapsed, case folded (ß as ss, which lower-casing alone would not do)."""
    return text.casefold(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def some(*columns: Column | str) -> Column:
    """The first that isn't empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def quoted(c: Column) -> Column:
    """A path percent-encoded, slashes kept."""
    out = F.url_encode(c)
    for had, has in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(had), F.lit(has))
    return out


#: A character of private use, that names don't hold.
_BETWEEN = "\ue000"


def names(c: Column) -> Column:
    """A name, or the names of a JSON list, without markup."""
    # cleaned in one piece, as Python can't run inside an array expression
    whole = F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), _BETWEEN)).otherwise(c)
    parts = F.transform(F.split(text.html_text(whole), _BETWEEN), lambda x: F.trim(x))
    return F.coalesce(F.array_join(F.filter(parts, lambda x: x != ""), ", "), F.lit(""))


def day(c: Column) -> Column:
    """The day of a time in milliseconds (nine digits or more), else the text as it is."""
    return F.when(c.rlike(r"^-?\d{9,}(\.\d+)?\z") | (c == "0"), F.date_format(F.timestamp_millis(c.try_cast("double").cast("bigint")), "yyyy-MM-dd")).otherwise(F.coalesce(c, F.lit("")))


def _rows(df: DataFrame, code: str, label: str, name: str, source: str, **fields: Column) -> DataFrame:
    """Rows of the columns of ROW, what isn't given '' or as before a review; those of an allowed licence."""
    given = {c: F.lit(_REVIEW.get(c, "")) for c in ROW} | fields
    given |= {"seafood_code": F.lit(code), "app_label": F.lit(label), "scientific_name": F.lit(name), "source_dataset": F.lit(source), "license": urls.licence(given["license"])}
    given["image_id"] = text.stable_id(F.lit(code), F.lit(source), given["source_record_id"])
    return df.select(*[F.coalesce(given[c].cast("string"), F.lit("")).alias(c) for c in ROW]).filter(F.col("license").isin(*urls.LICENCES))


def _exact(c: Column, name: str) -> Column:
    return name_key(c) == name_key(F.lit(name))


def inat(observations: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    df = observations.filter((some("taxon.name") == "") | _exact(F.col("taxon.name"), name)).select("*", F.explode("photos").alias("p"))
    number = F.col("id").cast("string")
    return _rows(
        df, code, label, name, "INATURALIST", source_record_id=F.concat(F.lit("obs:"), number, F.lit("/photo:"), F.col("p.id")), source_taxon_match=F.lit("EXACT"), source_url=some(F.col("uri"), F.concat(F.lit("https://www.inaturalist.org/observations/"), number)),
        image_url=F.regexp_replace("p.url", r"/(square|small|medium)\.", "/large."), creator=text.html_text(some("p.attribution", "user.login")), license=some("p.license_code", "p.license"), attribution=text.html_text(F.col("p.attribution")),
        source_observation_quality=F.col("quality_grade"), source_location=F.col("place_guess"), source_date=some("observed_on", "time_observed_at"), original_group_id=F.concat(F.lit("INATURALIST-OBS-"), number),
    )


def gbif(occurrences: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    df = occurrences.select("*", F.posexplode("media").alias("i", "m")).filter(F.lower(some("m.type")).isin("", "stillimage", "still image"))
    number = F.col("key").cast("string")
    match = F.when(name_key(some("species", "acceptedScientificName", "scientificName")).startswith(name_key(F.lit(name))), "EXACT").otherwise("QUERY_TAXON")
    return _rows(
        df, code, label, name, "GBIF", source_record_id=F.concat(F.lit("occ:"), number, F.lit("/media:"), some(F.col("m.identifier"), F.col("m.title"), F.col("i").cast("string"))), source_taxon_match=match, source_url=some(F.col("references"), F.concat(F.lit("https://www.gbif.org/occurrence/"), number)),
        image_url=some("m.identifier", "m.references"), creator=text.html_text(F.col("m.creator")), license=F.col("m.license"), license_url=F.col("m.license"), attribution=text.html_text(some("m.title", "m.description")), source_observation_quality=F.col("basisOfRecord"),
        source_country=some("country", "countryCode"), source_location=some("locality", "stateProvince"), source_date=some("eventDate", "year"), original_group_id=F.concat(F.lit("GBIF-OCC-"), number),
    ).filter("image_url <> ''")


def commons(pages: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    meta = lambda key: F.col("i.extmetadata")[key]["value"]
    df = pages.select("*", F.get("imageinfo", F.lit(0)).alias("i")).filter("i IS NOT NULL").filter((some("i.mime") == "") | F.col("i.mime").startswith("image/"))
    number, title = F.col("pageid").cast("string"), some("title")
    return _rows(
        df, code, label, name, "WIKIMEDIA_COMMONS", source_record_id=F.concat_ws(":", F.lit("page"), number, title), source_taxon_match=F.lit("EXACT_CATEGORY"), source_url=some(F.col("i.descriptionurl"), F.concat(F.lit("https://commons.wikimedia.org/wiki/"), quoted(F.replace(title, F.lit(" "), F.lit("_"))))),
        image_url=F.col("i.url"), creator=text.html_text(meta("Artist")), license=some(meta("LicenseShortName"), meta("UsageTerms")), license_url=text.html_text(meta("LicenseUrl")), attribution=text.html_text(some(meta("Credit"), meta("Attribution"))),
        source_date=text.html_text(some(meta("DateTimeOriginal"), meta("DateTime"))), original_group_id=F.concat(F.lit("COMMONS-PAGE-"), number),
    )


def ala(occurrences: DataFrame, code: str, name: str, proxy: str, label: str = "") -> DataFrame:
    """proxy: what stands before an image's id in its address."""
    own = F.trim(some("uuid", "id"))
    listed = F.filter(F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    images = F.when((F.size(listed) == 0) & (some("imageUrl") != ""), F.array(F.lit("primary"))).otherwise(listed)
    df = occurrences.filter(_exact(F.col("scientificName"), name) & (own != "")).select("*", own.alias("own"), F.posexplode(images).alias("i", "image"))
    url = some(F.when(F.col("i") == 0, F.col("imageUrl")), F.when(F.col("image") != "primary", F.concat(F.lit(proxy), quoted(F.col("image")))))
    return _rows(
        df, code, label, name, "ATLAS_OF_LIVING_AUSTRALIA", source_record_id=F.concat(F.lit("occ:"), F.col("own"), F.lit("/image:"), F.col("image")), source_taxon_match=F.lit("EXACT"), source_url=some(F.col("references"), F.concat(F.lit("https://biocache.ala.org.au/occurrences/"), quoted(F.col("own")))),
        image_url=url, creator=names(F.col("recordedBy")), license=F.col("license"), license_url=F.col("license"), attribution=names(F.col("recordedBy")), source_observation_quality=some("identificationVerificationStatus", "basisOfRecord"),
        source_country=F.col("country"), source_location=some("locality", "stateProvince"), source_date=day(F.col("eventDate")), original_group_id=F.concat(F.lit("ALA-OCC-"), F.col("own")),
    ).filter("image_url <> ''")


def obis(occurrences: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    own = F.trim(some("id", "occurrenceID"))
    media = F.when(F.col("associatedMedia").startswith("["), F.from_json("associatedMedia", "array<string>")).otherwise(F.split("associatedMedia", r"\s*[|;]\s*|,\s*(?=https?://)"))
    safe = F.filter(F.transform(media, lambda x: F.trim(x)), lambda u: u.startswith("https://"))
    df = occurrences.filter(_exact(F.col("scientificName"), name) & (own != "")).select("*", own.alias("own"), F.posexplode(safe).alias("i", "u"))
    return _rows(
        df, code, label, name, "OBIS", source_record_id=F.concat(F.lit("occ:"), F.col("own"), F.lit("/media:"), F.col("i") + 1), source_taxon_match=F.lit("EXACT"), source_url=some(F.col("references"), F.concat(F.lit("https://obis.org/occurrence/"), quoted(F.col("own")))), image_url=F.col("u"),
        creator=names(F.col("recordedBy")), license=F.col("license"), license_url=F.col("license"), attribution=names(F.col("recordedBy")), source_observation_quality=F.col("basisOfRecord"), source_country=F.col("country"), source_location=F.col("locality"),
        source_date=day(F.col("eventDate")), original_group_id=F.concat(F.lit("OBIS-OCC-"), F.col("own")),
    )


def smithsonian(records: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    about = "content.descriptiveNonRepeating"
    own = F.trim(some("id"))
    # names are joined, so that one call of the case folding serves all of a record's
    said = name_key(F.array_join(F.transform("content.indexedStructured.scientific_name", lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), "|"))
    df = records.filter(F.array_contains(F.split(said, r"\|"), name_key(F.lit(name))) & (own != "")).select("*", own.alias("own"), F.posexplode(f"{about}.online_media.media").alias("i", "m"))
    df = df.filter(F.lower("m.type").isin("image", "images", "stillimage") & (urls.licence(F.col("m.usage.access")) == "CC0") & F.trim("m.content").startswith("https://"))
    holder = text.html_text(some(F.col(f"{about}.data_source"), F.lit("Smithsonian Institution")))
    return _rows(
        df, code, label, name, "SMITHSONIAN_OPEN_ACCESS", source_record_id=F.concat(F.lit("record:"), F.col("own"), F.lit("/media:"), some(F.col("m.guid"), (F.col("i") + 1).cast("string"))), source_taxon_match=F.lit("EXACT"),
        source_url=F.regexp_replace(some(F.col(f"{about}.record_link"), F.concat(F.lit("https://www.si.edu/object/"), quoted(F.col("own")))), "^http://", "https://"), image_url=F.trim("m.content"), creator=holder, license=F.lit("CC0"),
        license_url=F.lit("https://creativecommons.org/publicdomain/zero/1.0/"), attribution=holder, source_observation_quality=F.lit("MUSEUM_COLLECTION"), original_group_id=F.concat(F.lit("SMITHSONIAN-RECORD-"), F.col("own")), image_context=F.lit("MUSEUM"),
    )


#: Marks of the agency in a credit.
AGENCY = ("NOAA", "NMFS", "SEFSC", "NEFSC", "AFSC", "NWFSC", "PIFSC")
SITE = "https://www.noaa.gov"


def noaa(pages: DataFrame, code: str, name: str, label: str = "") -> DataFrame:
    """pages: html. Photo blocks with an image whose title holds the whole name and ends in an agency's credit, and a download link."""
    df = pages.select(F.explode(F.split("html", """(?i)(?=<div\\b[^>]*class\\s*=\\s*["'](?:[^"']*\\s)?ngdl-photo[\\s"'])""")).alias("block")).filter(F.col("block").rlike(r"(?i)^<div\b[^>]*[\s\"']ngdl-photo"))
    opening, image = F.regexp_extract("block", r"(?is)^<div\b[^>]*>", 0), F.regexp_extract("block", r"(?is)<img\b[^>]*>", 0)
    link = F.regexp_extract("block", r"""(?is)<a\b[^>]*class\s*=\s*["'][^"']*\bmedia-download-link\b[^>]*>""", 0)
    title = F.when(text.attribute(image, "title") != "", text.attribute(image, "title")).otherwise(text.attribute(image, "alt"))
    full = lambda u: F.when(u.startswith("/"), F.concat(F.lit(SITE), u)).otherwise(u)
    page = text.attribute(F.regexp_extract("block", r"(?is)<a\b[^>]*href[^>]*>", 0), "href")
    df = df.select(text.attribute(opening, "id").alias("photo"), title.alias("title"), full(text.attribute(link, "href")).alias("url"), full(page).alias("page"))
    df = df.withColumn("credit", text.html_text(F.regexp_extract("title", r"(?i)\(Image credit:\s*(.*?)\)\s*$", 1)))
    credited = F.upper("credit").rlike("|".join(AGENCY)) & ~F.upper("credit").contains("COURTESY")
    df = df.filter((F.col("photo") != "") & F.col("url").startswith("https://") & text.contains_name(F.col("title"), name) & credited)
    return _rows(
        df, code, label, name, "NOAA_PHOTO_LIBRARY", source_record_id=F.concat(F.lit("photo:"), "photo"), source_taxon_match=F.lit("EXACT_TITLE"), source_url=some(F.col("page"), F.lit(f"{SITE}/noaa-collections/search/photo-library")), image_url=F.col("url"), creator=F.col("credit"),
        license=F.lit("public domain"), license_url=F.lit(f"{SITE}/disclaimer"), attribution=F.col("title"), source_observation_quality=F.lit("NOAA_CREDITED"), original_group_id=F.concat(F.lit("NOAA-PHOTO-"), "photo"),
    )


def vista(records: DataFrame, code: str, name: str, repository: str = "", label: str = "") -> DataFrame:
    """repository: what stands before a file's name in its address ('': images have their original addresses). records say which split they are of."""
    df = records.filter(_exact(some("standardized_species", "species"), name))
    path, original = F.trim(some("file_name")), F.trim(some("original_url"))
    record = some(F.col("arkid"), F.col("source_filename"), path, F.trim(some("filename")))
    placed = F.when((path != "") & F.lit(repository != ""), F.concat(F.lit(repository), quoted(path), F.lit("?download=true"))).otherwise(original)
    rows = _rows(
        df, code, label, name, "FISH_VISTA", source_record_id=record, source_taxon_match=F.lit("EXACT"), source_url=some(original, F.col("arkid")), image_url=placed, creator=F.col("owner"), license=F.col("license"), license_url=F.col("license"), attribution=some("owner", "source"),
        source_observation_quality=F.lit("CURATED_DATASET"), source_split=F.col("source_split"), image_context=F.lit("MUSEUM"), original_group_id=F.concat(F.lit("FISH-VISTA-"), some(F.col("source_filename"), record)),
    )
    return rows.filter("source_record_id <> ''")


def vista_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """The tables of a data set's splits as one, each row with the name of its split; columns that a table lacks are null."""
    out = None
    for split, df in frames.items():
        rows = df.withColumn("source_split", F.lit(split))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
