"""Every registered query with SQL gives the same rows as DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tickwell.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def tidy(rows):
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        rows[c] = rows[c].astype(float).round(5) + 0.0 if rows[c].dtype.kind in "fi" else rows[c].astype(str)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    a, b = tidy(registry.QUERIES[name](spark, DATA).toPandas()), tidy(duck.sql(registry.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            off = (a[c] - b[c]).abs().fillna(0)
            assert (a[c].isna() == b[c].isna()).all() and (off <= 2e-5 * (1 + b[c].abs().fillna(0))).all(), c
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
