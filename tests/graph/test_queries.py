"""Every registered query against DuckDB on the smallest tables; those without SQL must give rows."""

import os

import duckdb
import pytest

from graphloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def said(value):
    return "null" if value is None or value != value else f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    rows = sorted(tuple(said(v) for v in r) for r in df.collect())
    if name not in plans.ORACLES:
        assert rows
        return
    want = oracle.sql(plans.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert rows == sorted(tuple(said(r[k]) for k in order) for r in want.fetchall())
