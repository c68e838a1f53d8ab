"""The members of every cell, against SQL without a choice of cells."""

import os

import duckdb
import pytest

from uvsieve.jobs.catalogue import QUERIES
from uvsieve.jobs.oracle import sql
from uvsieve.operators import cells

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_members_of_every_cell(spark):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = con.sql(sql("SELECT u_bin, v_bin, row_number() OVER (PARTITION BY u_bin, v_bin ORDER BY newrow) AS place, newrow, round(value,6) AS value, flag FROM binned")).fetchall()
    got = [tuple(r) for r in QUERIES["group_members"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)
    assert len({r[0] for r in got}) > 4


def test_members_of_a_hot_cell_are_numbered_over_ranges(spark):
    rows = spark.range(1000).selectExpr("1 AS u_bin", "cast(id % 97 = 0 AS int) AS v_bin", "id * 3 AS newrow")
    got = cells.members(rows, width=100).collect()
    for v in (0, 1):
        own = sorted((r["place"], r["newrow"]) for r in got if r["v_bin"] == v)
        assert own == list(enumerate(sorted(3 * k for k in range(1000) if (k % 97 == 0) == v), 1))
