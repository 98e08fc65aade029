"""Hosts against the standard library's addresses and name codec."""

import ipaddress
import itertools
import random

from pyspark.sql import functions as F

from siltstone.functions import hosts


def test_address_classes_are_those_of_the_library():
    r = random.Random(1)
    near = lambda nets: ((n.version, e + d) for n in map(ipaddress.ip_network, nets) for d in (-1, 0, 1) for e in (int(n.network_address), int(n.broadcast_address)))
    some = itertools.chain(
        near([*hosts.LOCAL_4, *hosts.GLOBAL_4, "192.0.0.170/31", "255.255.255.255/32"]), near([*hosts.LOCAL_6, *hosts.GLOBAL_6, "::ffff:0:0/96"]), ((6, (0xFFFF << 32) + x) for _, x in near(hosts.LOCAL_4)),
        ((4, r.getrandbits(32)) for _ in range(5000)), ((6, r.getrandbits(128) >> r.choice([0, 8, 60, 90, 96])) for _ in range(5000)),
    )
    for version, x in some:
        if 0 <= x < 2 ** (32 if version == 4 else 128):
            a = (ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address)(x)
            assert hosts.is_global(a) == a.is_global, a


WANT = {
    "http://Example.ORG": "https://example.org/", "https://bücher.example/a?b#c": "https://xn--bcher-kva.example/a?b#c", "https://8.8.8.8:80/x": "https://8.8.8.8:80/x", "https://10.0.0.1/": None, "https://127.0.0.1": None,
    "https://[2001:4860:4860::8888]/": "https://[2001:4860:4860::8888]/", "https://[::1]/": None, "https://[2001:DB8::1]:443/": None, "https://2001:4860::1/": None, "https://1.2.3/": "https://1.2.3/", "https://a.b.c.1/": "https://a.b.c.1/", "https://256.1.1.1/": "https://256.1.1.1/",
    "https://localhost/": None, "https://x.localhost/": None, "https://x.invalid/": None, "https://name/": None, "https://a..b.org/": None, "https://-a.org/": None, "https://a_b.org/": None, "https://u@a.org/": None, "https://a.org:99999/": None, "https://a.org:/p": "https://a.org/p", "https://a.org:0443/": "https://a.org:443/",
    "https://a.org/ b": None, "ftp://a.org/": None, "https:///x": None, "": None, None: None, "https://ß.de": "https://ss.de/", "https://例え.テスト/": "https://xn--r8jz45g.xn--zckzah/", "https://[::ffff:8.8.8.8]/": "https://[::ffff:8.8.8.8]/", "https://[8.8.8.8]/": None, "https://" + "a" * 64 + ".org/": None, "HTTPS://A.org?q=1": "https://a.org/?q=1", "https://a.org#f": "https://a.org/#f",
}


def test_urls_with_any_host(spark):
    rows = spark.createDataFrame(list(enumerate(WANT)), "i int, u string").repartition(2)
    got = {x.i: x.n for x in rows.select("i", hosts.normalized(F.col("u")).alias("n")).collect()}
    assert {u: got[i] for i, u in enumerate(WANT)} == WANT
