"""Edge tables derived from the star schema, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER_BASE = 1_000
PART_BASE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, c_nationkey) of every line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).select("l_suppkey", "c_nationkey")


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade with each other, by number of lines."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Lines are counted by customer nation and supplier before suppliers' nations are looked up.
    pairs = _customers(spark, sf_dir).groupBy("l_suppkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    a, b = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    return both.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.sum("n").alias("w"))


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nations and the suppliers of their lines, by number of lines."""
    return _customers(spark, sf_dir).groupBy(F.col("c_nationkey").cast("long").alias("u"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("v")).agg(F.count(F.lit(1)).alias("w"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers, by quantity."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + PART_BASE).alias("v")).agg(F.sum(F.col("l_quantity").cast("int").cast("long")).alias("w"))


NATION_SQL = """SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v, count(*)::BIGINT AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""
SUPPLIER_SQL = f"""SELECT c_nationkey::BIGINT AS u, l_suppkey + {SUPPLIER_BASE} AS v, count(*)::BIGINT AS w
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
PART_SQL = f"""SELECT l_partkey AS u, l_suppkey + {PART_BASE} AS v, sum(trunc(l_quantity)::INT)::BIGINT AS w FROM lineitem GROUP BY 1, 2"""


def prim_sql(graph: str) -> str:
    """Prim's algorithm as a recursive query; the graph must be connected."""
    return f"""
WITH RECURSIVE g AS MATERIALIZED ({graph}),
e AS MATERIALIZED (SELECT u AS src, v AS dst, u, v, w FROM g UNION ALL SELECT v, u, u, v, w FROM g),
t AS (SELECT [(SELECT min(u) FROM g)] AS seen, NULL::BIGINT AS u, NULL::BIGINT AS v, NULL::BIGINT AS w
    UNION ALL
    SELECT * FROM (SELECT list_append(t.seen, e.dst) AS seen, e.u, e.v, e.w FROM t JOIN e ON list_contains(t.seen, e.src) AND NOT list_contains(t.seen, e.dst)
        ORDER BY e.w, e.u, e.v LIMIT 1) AS x)
SELECT u, v, w FROM t WHERE u IS NOT NULL"""


def components_sql(graph: str) -> str:
    """Least reachable vertex of every vertex."""
    return f"""
WITH RECURSIVE g AS MATERIALIZED ({graph}),
e AS MATERIALIZED (SELECT u AS a, v AS b FROM g UNION SELECT v, u FROM g),
r AS (SELECT a AS id, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON r.id = e.a WHERE r.label < e.b)
SELECT id, min(label) AS component FROM r GROUP BY id"""
