"""Every registered query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from uvsieve.jobs.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in ("events", "supplier", "region"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), found.columns)


def test_sql_has_no_stray_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
