"""Queries with SQL give the rows that DuckDB gives."""

import os
import zlib

import duckdb
import pytest

from sitegauge.llm import queries
from sitegauge.llm.oracles import _TABLE, SQL, _crc


def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rel = duck(sf).execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_checksums_in_sql():
    got = duckdb.connect().execute(f"WITH {_TABLE} SELECT n, {_crc('n')} FROM range(2000) AS r(n), tab").fetchall()
    assert all(zlib.crc32(str(n).encode()) == c for n, c in got)

