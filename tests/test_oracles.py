"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from sitegauge.plans import queries as site

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(site.queries()))
def test_query(spark, duck, name):
    df = site.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in site.oracle_sql():
        assert rows
        return
    rel = duck.execute(site.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert rows == want


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
