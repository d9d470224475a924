"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float) and not isinstance(v, bool):
        return f"{v + 0.0:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.SQL:
        found = duck.sql(catalog.SQL[name])
        assert columns == sorted(found.columns)
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
