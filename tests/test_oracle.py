"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from cubeloom.plans import catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: What needs more data than the smallest tables have.
LARGER = {"extract_point", "upsample_nearest", "resample_max", "coregister", "tseries_point"}


def one(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, str) or type(v).__name__ in ("bool", "bool_"):
        return str(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return f"{float(v) + 0.0:.5f}"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(tuple(map(one, r)) for r in f[columns].itertuples(index=False))
    a, b = rows(got), rows(want)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert got.columns and got.count() > 0
