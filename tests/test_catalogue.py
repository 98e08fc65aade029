"""Each registered query against its SQL in DuckDB on the small driver tables."""

import math
import os

import duckdb
import pytest

from siltstone.plans import catalogue, exchange, files, history  # noqa: F401  they register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted([tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in found.fetchall()])
    got = sorted([tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()])
    assert got == want
    assert want or name in ("bounded_chunk",)
