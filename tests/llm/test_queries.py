"""Registered queries of the training-data operators that have a SQL twin, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparkloom.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    tidy = lambda d: d[columns].fillna(-1).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-9)
