"""Scalar rules of imports, exports and receipts, as expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text, urls

#: The suffixes an image file may have.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif")
#: Hosts of sources that are slowed down together, by name; the first takes 6.5 seconds between requests, all others 1.
SLOW_HOSTS = ("wikimedia.org", "wikipedia.org")
SOURCE_HOSTS = {"inaturalist": ("inaturalist.org",), "gbif": ("gbif.org",), "fish-vista": ("fishair.org", "fish-vista.org", "fishvista.org")}
#: Stable categories of download and file errors.
ERROR_CATEGORIES = {
    "INVALID_IMAGE": ("ADD_RECOVERY_INVALID",),
    "FILESYSTEM_ERROR": (
        "ROOT_UNSAFE", "PATH_UNSAFE", "PARENT_UNSAFE", "SOURCE_UNSAFE", "TARGET_UNSAFE", "TARGET_CONFLICT", "STAGING_FILE_UNSAFE", "STAGING_PATH_INVALID", "STAGING_CONTENT_MISMATCH",
        "FILESYSTEM_OPERATION_FAILED", "LOG_WRITE_FAILED",
    ),
    "INDEX_ERROR": ("INDEX_READ_FAILED", "INDEX_WRITE_FAILED"),
    "SETUP_ERROR": ("LOG_PATH_UNSAFE", "LOG_SETUP_FAILED", "OPERATION_SETUP_FAILED"),
    "UNEXPECTED_ERROR": ("UNEXPECTED_OPERATION_FAILURE",),
}
DOWNLOAD_CODES = ("NETWORK_ERROR", "INVALID_IMAGE", "DOWNLOAD_ERROR", "FILESYSTEM_ERROR")


def import_licence(c: Column) -> Column:
    """The code of a redistributable licence with its version, or null: whole codes only, in either case."""
    code = F.replace(F.upper(text.identifier(c)), F.lit("_"), F.lit("-"))
    whole = code.rlike(r"^(?:CC-(?:BY|BY-NC|BY-NC-SA|BY-SA)|CC0|PUBLIC-DOMAIN)(?:[- ]\d+(?:\.\d+)?)?\z")
    return F.when(whole, F.replace(code, F.lit(" "), F.lit("-")))


def attribution(given: Column, creator: Column, source: Column, record: Column) -> Column:
    """The first that isn't blank of attribution, creator, and source with record."""
    said = lambda c: F.nullif(text.human(c), F.lit(""))
    return F.coalesce(said(given), said(creator), F.concat_ws(" ", source, record))


def millis_date(millis: Column) -> Column:
    """The UTC day of milliseconds since 1970, as text."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def used_hosts(*addresses: Column) -> Column:
    """The distinct hosts of addresses, ascending, as compact JSON."""
    hosts = F.array(*[F.regexp_replace(F.regexp_replace(F.coalesce(urls.host(a), F.lit("")), r":\d+$", ""), r"\.+$", "") for a in addresses])
    return F.to_json(F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != ""))))


def _below(domains: Sequence[str]) -> Callable[[Column], Column]:
    """A test of whether a host is one of the domains or below it."""

    def test(host: Column) -> Column:
        found = F.lit(False)
        for name in domains:
            found = found | (host == name) | host.endswith(f".{name}")
        return found

    return test


def source_bucket(*addresses: Column) -> Column:
    """The name of the source an address belongs to and the seconds between its requests, as a struct."""
    hosts = F.filter(F.array(*[F.regexp_replace(F.regexp_replace(F.coalesce(urls.host(a), F.lit("")), r":\d+$", ""), r"\.+$", "") for a in addresses]), lambda h: h != "")
    name = F.when(F.exists(hosts, _below(SLOW_HOSTS)), "wikimedia")
    for source, domains in SOURCE_HOSTS.items():
        name = name.when(F.exists(hosts, _below(domains)), source)
    name = name.otherwise(F.concat(F.lit("host:"), F.coalesce(F.try_element_at(hosts, F.lit(1)), F.lit("unknown"))))
    return F.struct(name.alias("bucket"), F.when(name == "wikimedia", 6.5).otherwise(1.0).alias("seconds"))


def error_category(stage: Column, code: Column) -> Column:
    """The stable category of an error of the stage ``download`` or ``operation``."""
    operation = F.lit("OPERATION_ERROR")
    for category, codes in ERROR_CATEGORIES.items():
        operation = F.when(code.isin(*codes), category).otherwise(operation)
    return F.when(stage == "download", F.when(code.isin(*DOWNLOAD_CODES), code).otherwise("DOWNLOAD_ERROR")).otherwise(operation)


def file_name(c: Column, fallback: str = "candidates.csv") -> Column:
    """The last part of a path with word characters, dots and dashes only, 255 characters at most."""
    last = F.element_at(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(last, r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", fallback).otherwise(clean), 1, 255)


#: From the first character that a part may start with: what makes 128 characters of it, one a plain character or run of others.
_PART = r"\A[^A-Za-z0-9-]*+([A-Za-z0-9-](?:[^A-Za-z0-9_.-]++|[A-Za-z0-9_.-]){0,127}+)"


def path_part(c: Column, fallback: str) -> Column:
    """A name as one part of a path: ASCII letters, digits, dots and dashes, 128 characters at most.

    Dots and underscores at the end go only if nothing but such follows in the whole name.
    """
    name = F.coalesce(c, F.lit(""))
    part = F.regexp_replace(F.regexp_extract(name, _PART, 1), "[^A-Za-z0-9_.-]+", "_")
    goes_on = name.rlike(_PART + "[^A-Za-z0-9-]*+[A-Za-z0-9-]")
    return F.when(part == "", fallback).when(goes_on, part).otherwise(F.rtrim(part, F.lit("._")))


def receipt_path_ok(path: Column, expected: Column, action: Column) -> Column:
    """Whether a receipt may name ``path``: the expected one, with another image suffix only for ADD."""
    folder = lambda c: F.regexp_replace(c, r"[^/]*\z", "")
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?\z", 1)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))
    plain = ~path.rlike(r"[\\\x00-\x1F]") & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    return plain & ((action == "ADD") | (path == expected)) & (folder(path) == folder(expected)) & (stem(path) == stem(expected)) & suffix.isin(*IMAGE_SUFFIXES, ".image")


def channels_first(pixels: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """RGBA bytes, pixel after pixel, as normalised floats, channel after channel; null unless whole pixels with three non-zero deviations."""
    if len(mean) != 3 or len(std) != 3 or not all(std):
        raise ValueError("three means and three non-zero deviations")
    n = F.floor(F.size(pixels) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    plane = lambda c: F.transform(places, lambda i: ((F.get(pixels, i * 4 + c) / 255 - mean[c]) / std[c]).cast("float"))
    return F.when(F.size(pixels) % 4 == 0, F.concat(plane(0), plane(1), plane(2)))
