"""Text clean-up, codes and fingerprints, as expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[ \t\n\r\f\x0B]+"
#: Device names that no code may take.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])


def has_control(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1F\x7F]")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def human(c: Column) -> Column:
    """White space collapsed to single spaces; null if other control characters are left."""
    spaced = F.regexp_replace(c, r"[\r\n\t]", " ")
    return F.when(~has_control(spaced), F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def identifier(c: Column) -> Column:
    return F.when(~has_control(c), trimmed(c))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), SPACE, " "))


@F.pandas_udf(StringType())
def unescape(c: pd.Series) -> pd.Series:
    """HTML entities replaced."""
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def casefold(c: pd.Series) -> pd.Series:
    return c.str.casefold()


def html_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"(?U)\s+", " "))


def attribute(fragment: Column, name: str) -> Column:
    """The value of an HTML attribute, unescaped."""
    return unescape(F.regexp_extract(fragment, rf"""(?i)(?<![\w-]){name}\s*=\s*(["'])(.*?)\1""", 2))


def contains_name(c: Column, name: str) -> Column:
    """Whether a text holds the whole name, not inside a longer word, in any case."""
    return c.rlike("(?i)(?<![A-Za-z])" + "".join(x if x.isalnum() else "\\" + x for x in name) + "(?![A-Za-z])")


def stable_id(code: Column, source: Column, record: Column) -> Column:
    return F.concat(code, F.lit("-"), F.substring(F.sha2(F.concat_ws("|", code, source, record), 256), 1, 16))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def map_fingerprint(c: Column) -> Column:
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), 256)


def is_safe_code(c: Column) -> Column:
    return c.rlike(r"^[A-Z][A-Z0-9_-]{0,31}\z") & ~c.isin(*RESERVED)


def is_safe_path(c: Column, most: int = 255) -> Column:
    """A relative path of plain components: no backslash, drive, dot segment, trailing dot or space, device name; ``most`` UTF-16 units."""
    parts = F.split(c, "/")
    stem = lambda p: F.upper(F.element_at(F.split(p, r"\."), 1))
    return ~c.rlike(r"[\\:]") & ~has_control(c) & (F.octet_length(F.encode(c, "UTF-16BE")) <= 2 * most) & F.forall(parts, lambda p: (p != "") & ~p.isin(".", "..") & ~p.rlike(r"[. ]\z") & ~stem(p).isin(*RESERVED))


def source_date(c: Column) -> Column:
    """ISO dates and d.m.yyyy at the start of a text, and "d Month yyyy" or "d Mon yyyy" in it; else null."""
    iso = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:\D|\z)", 1)
    dotted = F.regexp_extract(c, r"^(\d{1,2}\.\d{1,2}\.\d{4})(?:\D|\z)", 1)
    named = F.initcap(F.regexp_extract(c, r"\b(\d{1,2} [A-Za-z]+ \d{4})\b", 1))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(dotted, "d.M.yyyy"), F.try_to_date(named, "d MMMM yyyy"), F.try_to_date(named, "d MMM yyyy"))


def redacted(c: Column) -> Column:
    """A map without the values of secret-looking keys."""
    return F.transform_values(c, lambda k, x: F.when(k.rlike("(?i)password|hash|token|csrf|secret"), "[REDACTED]").otherwise(x))
