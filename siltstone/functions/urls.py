"""URLs, hosts and licences, as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The licences that may be collected.
LICENCES = ("CC0", "CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-NC-SA", "PUBLIC-DOMAIN")


def _c(url: str | Column) -> Column:
    return F.col(url) if isinstance(url, str) else url


def is_web(url: str | Column) -> Column:
    return _c(url).rlike("^https?://")


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(url), "^https?://([^/?#]+)", 1))


def path(url: str | Column) -> Column:
    found = F.regexp_extract(_c(url), "^https?://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: str | Column) -> Column:
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def without_query(url: str | Column) -> Column:
    return F.concat(F.lit("https://"), host(url), path(url))


def canonical(url: str | Column) -> Column:
    """https, lower-case host, no default port, no fragment: equal for URLs of one resource."""
    q = query(url)
    return F.concat(F.lit("https://"), F.regexp_replace(host(url), ":443$", ""), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def without_tracking(url: str | Column) -> Column:
    """Without utm_*, fbclid and gclid parameters; the rest stays in order."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|fbclid|gclid)(=|$)"))
    return F.concat(F.lit("https://"), host(url), path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def normalized(url: str | Column) -> Column:
    """An https URL with a public host name, or null: no credentials, white space, local or numeric hosts."""
    u = F.trim(_c(url))
    h = F.regexp_replace(host(u), r":\d+$", "")
    labels = h.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])?$")
    bad = u.rlike(r"\s") | host(u).contains("@") | h.rlike(r"(^|\.)(localhost|invalid)$") | ~labels
    return F.when(is_web(u) & ~bad, F.concat(F.lit("https://"), host(u), F.regexp_replace(F.regexp_replace(u, "^https?://[^/?#]+", ""), "^(?=[?#]|$)", "/")))


def host_allowed(h: Column, allowed: Sequence[str]) -> Column:
    """Whether a host is in a short list; ``.suffix`` stands for the suffix and all below it."""
    tests = [h.endswith(a) | (h == a[1:]) if a.startswith(".") else h == a for a in allowed]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def image_suffix(url: str | Column) -> Column:
    found = F.lower(F.regexp_extract(path(url), r"(\.[A-Za-z]+)$", 1))
    return F.when(found.isin(".jpg", ".jpeg", ".png", ".webp", ".gif"), found).otherwise(".image")


def large_photo(url: str | Column) -> Column:
    """The large rendition of a photo URL that ends in size.extension."""
    return F.regexp_replace(F.regexp_replace(_c(url), "[?#].*$", ""), r"/(square|small|medium|large|original)\.([A-Za-z]+)$", "/large.$2")


#: A whole Creative Commons code: alone or at the end of words, or in the licence's address; version and page aside.
_CC = r"^(?:(?:https?://)?creativecommons\.org/licenses/|(?:.*-)?cc-?|)(by(?:-nc)?(?:-sa|-nd)?)(?:[-/]\d+(?:[.-]\d+)*)?(?:-\((?:int|international)\))?(?:/(?:legalcode|deed(?:\.[a-z-]+)?))?/?$"


def licence(c: Column) -> Column:
    """A short licence code from codes, names and addresses of licences; '' when unknown. Mere mentions are no licence."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_-]+", "-")
    zero = t.isin("cc0", "cc-0", "cc-zero") | t.contains("publicdomain/zero") | t.contains("cc0-1.0")
    free = (t == "pd") | t.contains("publicdomain/mark") | t.contains("public-domain")
    code = F.regexp_extract(t, _CC, 1)
    return F.when(zero, "CC0").when(free, "PUBLIC-DOMAIN").when(code != "", F.concat(F.lit("CC-"), F.upper(code))).otherwise("")


def licence_allowed(c: Column) -> Column:
    return licence(c).isin(*LICENCES)
