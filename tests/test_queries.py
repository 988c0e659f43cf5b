"""Every query with an oracle, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracewell.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events", "documents"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def rows(frame_rows, columns):
    return sorted((tuple(r) for r in frame_rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    found, expected = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    assert rows(found.select(*columns).collect(), columns) == rows(expected.select(*[f'"{c}"' for c in columns]).fetchall(), columns)
