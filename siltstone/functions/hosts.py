"""Hosts that are addresses or not plain ASCII names, in the form that a URL has them."""

from __future__ import annotations

import re
from bisect import bisect_right
from ipaddress import IPv4Address, IPv6Address, ip_address, ip_network

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The networks of the special-purpose registries that aren't reachable from everywhere, and the parts of them that are.
LOCAL_4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
GLOBAL_4 = ("192.0.0.9/32", "192.0.0.10/32")
LOCAL_6 = ("::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
GLOBAL_6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _edges(local: tuple[str, ...], reachable: tuple[str, ...]) -> tuple[list[int], list[bool]]:
    """Ascending first addresses of ranges, and whether a range is reachable from everywhere; reachable parts cut local ranges in two."""
    ranges = {0: True}
    for networks, what in ((local, False), (reachable, True)):
        for n in map(ip_network, networks):
            first, after = int(n.network_address), int(n.broadcast_address) + 1
            rest = ranges[max(k for k in ranges if k <= after)]
            ranges = {k: x for k, x in ranges.items() if not first <= k < after} | {first: what, after: rest}
    at = sorted(ranges)
    return at, [ranges[k] for k in at]


_4, _6 = _edges(LOCAL_4, GLOBAL_4), _edges(LOCAL_6, GLOBAL_6)
#: IPv4 in IPv6 form, for which the network shared by carriers counts as reachable.
_MAPPED = _edges(tuple(n for n in LOCAL_4 if n != "100.64.0.0/10"), GLOBAL_4)
_LABEL = re.compile(r"(?!-)[a-z0-9-]{1,63}(?<!-)")


def is_global(address: IPv4Address | IPv6Address) -> bool:
    """Whether an address is reachable from everywhere; an IPv4 address in IPv6 form is judged as IPv4."""
    mapped = address.ipv4_mapped if isinstance(address, IPv6Address) else None
    at, reachable = _MAPPED if mapped is not None else _4 if isinstance(address, IPv4Address) else _6
    address = address if mapped is None else mapped
    return reachable[bisect_right(at, int(address)) - 1]


def public_host(host: str) -> str | None:
    """The host as a URL has it: a global address (IPv6 in brackets) or a name of two labels or more in ASCII; else null."""
    bracketed = host.startswith("[") and host.endswith("]")
    bare = host[1:-1] if bracketed else host
    try:
        address = ip_address(bare)
    except ValueError:
        address = None
    if address is not None:
        if not is_global(address) or bracketed != isinstance(address, IPv6Address):
            return None
        return f"[{bare.lower()}]" if bracketed else bare
    if bracketed:
        return None
    try:
        name = host.encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    labels = name.split(".")
    if len(name) > 253 or len(labels) < 2 or labels[-1] in ("localhost", "invalid") or not all(map(_LABEL.fullmatch, labels)):
        return None
    return name


@F.pandas_udf(StringType())
def public(hosts: pd.Series) -> pd.Series:
    return hosts.map(public_host, na_action="ignore")


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1)


def normalized(url: Column) -> Column:
    """https URL of an absolute http(s) one with a public host, or null: no credentials, white space or control characters.

    Plain names are judged here; only other hosts go to Python.
    """
    at = authority(url)
    port = F.regexp_extract(at, r":(\d*)$", 1)
    host = F.regexp_replace(at, r":\d*$", "")
    name = F.lower(host)
    plain = name.rlike(r"^(?=.{1,253}\z)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])?\z") & ~name.rlike(r"\.(localhost|invalid)\z")
    found = F.when(plain, name).otherwise(public(F.when(~plain & (host != ""), host)))
    bad = url.rlike(r"(?U)\s|[\x00-\x1F\x7F]") | at.contains("@") | (F.length(port) > 5) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535)
    rest = F.regexp_replace(url, r"^(?i:https?)://[^/?#]*", "")
    fit = url.rlike(r"^(?i:https?)://[^/?#]") & ~bad & found.isNotNull()
    return F.when(fit, F.concat(F.lit("https://"), found, F.when(port != "", F.concat(F.lit(":"), port.cast("int").cast("string"))).otherwise(""), F.when(rest.startswith("/"), "").otherwise("/"), rest))
