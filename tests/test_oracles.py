"""Every registered query with a SQL twin, against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom.functions import generate
from sparkloom.functions.scalars import number_hash
from sparkloom.operators.histogram import histogram
from sparkloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    tidy = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", ["mst_partsupp", "mst_generated"])
def test_forest_queries_without_sql(spark, name):
    from test_graph import kruskal

    graph = registry.graphs.part_graph(spark, DATA) if name == "mst_partsupp" else registry.QUERIES["generated_graph"](spark, DATA)
    want = kruskal([(r.u, r.v, r.w) for r in graph.collect()])
    assert {(r.u, r.v, r.w) for r in registry.QUERIES[name](spark, DATA).collect()} == want and len(want) > 100


def test_generated_colors(spark):
    counts = {r.bucket: r.n for r in histogram(generate.random_colors(spark, 640 * 426)).collect()}
    assert len(counts) == 256 and sum(counts.values()) == 640 * 426 and max(counts.values()) < 2 * min(counts.values())
    import numpy as np

    x = np.array([0, 1, 5, 2**31 - 1, 2**31, 10**12, 2**40 + 7])
    got = [r.h for r in spark.createDataFrame([(int(v),) for v in x], "x long").select(number_hash("x", 9).alias("h")).collect()]
    assert got == generate._mixed(x, 9).tolist() and len(set(got)) == len(x)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
