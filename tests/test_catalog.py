"""Every query with SQL against DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from locusframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["scaffold", "k", "x", "y", "pi_x", "pi_y", "dxy", "fst"]
