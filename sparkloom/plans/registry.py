"""All reference-operator queries: name -> callable, and name -> SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import generate
from sparkloom.functions.scalars import digit, luma, number_hash_sql, run_name, truth_path
from sparkloom.operators import components as cc
from sparkloom.operators import edges as ed
from sparkloom.operators import histogram as hist
from sparkloom.operators import mst, stats
from sparkloom.sources import edgelist, file_sources, results
from sparkloom.staging import Stage

from . import graphs
from .graphs import NATION_SQL, PART_SQL, SUPPLIER_SQL, components_sql, prim_sql, table

QUERIES: dict = {}
ORACLES: dict = {}

THRESHOLD = 15
COMPONENT_WEIGHT = 11
GRAPH_SEED = 3


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Histograms

_SIZES = "SELECT p_size % 256 AS color FROM part"


def _hist_sql(colors: str) -> str:
    return f"SELECT r.b::INT AS bucket, coalesce(c.n, 0)::BIGINT AS n FROM range(256) r(b) LEFT JOIN (SELECT color, count(*) AS n FROM ({colors}) GROUP BY color) c ON r.b = c.color"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_size") % 256).alias("color"))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"r": "l_orderkey", "g": "l_partkey", "b": "l_suppkey", "a": "l_linenumber"}
    return table(spark, sf_dir, "lineitem").select(*((F.col(c) % 256).cast("int").alias(n) for n, c in keys.items()))


_PIXELS = "SELECT (l_orderkey % 256)::INT AS r, (l_partkey % 256)::INT AS g, (l_suppkey % 256)::INT AS b, (l_linenumber % 256)::INT AS a FROM lineitem"


@query(_hist_sql(_SIZES))
def hist_dense_256(spark, sf_dir):
    return hist.histogram(_sizes(spark, sf_dir))


@query(f"SELECT bucket FROM ({_hist_sql(_SIZES)}) WHERE n = 0")
def hist_zero_fill(spark, sf_dir):
    return hist.histogram(_sizes(spark, sf_dir)).where("n = 0").select("bucket")


@query(_hist_sql(_SIZES))
def hist_conditional(spark, sf_dir):
    return hist.conditional_histogram(_sizes(spark, sf_dir))


@query("SELECT l_returnflag, r.b::INT AS bucket, count(l_suppkey)::BIGINT AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN range(256) r(b) "
       "LEFT JOIN (SELECT l_returnflag AS k, l_suppkey FROM lineitem) l ON f.l_returnflag = l.k AND l.l_suppkey % 256 = r.b GROUP BY 1, 2")  # fmt: skip
def hist_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 256).cast("int").alias("color"))
    return hist.histogram(rows, by=("l_returnflag",))


@query(_hist_sql(f"SELECT trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)::INT AS color FROM ({_PIXELS})"))
def luma_hist(spark, sf_dir):
    return hist.histogram(_pixels(spark, sf_dir).select(luma("r", "g", "b").alias("color")))


@query(_hist_sql(f"SELECT unnest([r, g, b]) AS color FROM ({_PIXELS})"))
def rgb_hist(spark, sf_dir):
    return hist.histogram(hist.channels(_pixels(spark, sf_dir), ("r", "g", "b")))


@query(_hist_sql(f"SELECT unnest([r, g, b, a]) AS color FROM ({_PIXELS})"))
def rgba_hist(spark, sf_dir):
    return hist.histogram(hist.channels(_pixels(spark, sf_dir), ("r", "g", "b", "a")))


@query(f"SELECT color::INT AS grey, trunc(0.299::DOUBLE * color + 0.587::DOUBLE * color + 0.114::DOUBLE * color)::INT AS luma FROM (SELECT DISTINCT color FROM ({_SIZES}))")
def luma_of_greys(spark, sf_dir):
    return _sizes(spark, sf_dir).distinct().select(F.col("color").cast("int").alias("grey")).withColumn("luma", luma("grey", "grey", "grey"))


@query(f"SELECT bucket, n AS left_n, n + 1 AS right_n FROM ({_hist_sql(_SIZES)}) WHERE bucket % 50 = 7")
def hist_verify(spark, sf_dir):
    """What the verifier reports if one strategy's counts are wrong in some buckets: those buckets, with both counts."""
    colors = _sizes(spark, sf_dir)
    wrong = hist.conditional_histogram(colors).withColumn("n", F.col("n") + (F.col("bucket") % 50 == 7).cast("long"))
    return hist.differences(hist.histogram(colors), wrong)


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 5)::INT AS color FROM part")
def colors_round_robin(spark, sf_dir):
    rows = ed.scan(table(spark, sf_dir, "part").select("p_partkey"), F.lit(1).cast("long"), ("p_partkey",), inclusive=False, name="pos")
    return rows.select("p_partkey", (F.col("pos") % 5).cast("int").alias("color"))


_LINE = "l_orderkey * 8 + l_linenumber"


@query(_hist_sql(f"SELECT {number_hash_sql(_LINE, 0, '//', 'xor')} % 256 AS color FROM lineitem"))
def colors_random_hist(spark, sf_dir):
    """Random colours, one a line, and their histogram."""
    return hist.histogram(table(spark, sf_dir, "lineitem").select(generate.colors_of(_LINE).alias("color")))


# Splits, sorts and scans


@query(f"SELECT u, v, w FROM ({SUPPLIER_SQL}) WHERE w <= {THRESHOLD}")
def edge_split_leq(spark, sf_dir):
    return ed.split(graphs.supplier_graph(spark, sf_dir), THRESHOLD)[0]


@query(f"SELECT u, v, w FROM ({SUPPLIER_SQL}) WHERE w > {THRESHOLD}")
def edge_split_gt(spark, sf_dir):
    return ed.split(graphs.supplier_graph(spark, sf_dir), THRESHOLD)[1]


@query(f"SELECT u, v, w, (w <= {THRESHOLD})::INT AS is_leq, (w > {THRESHOLD})::INT AS is_gt FROM ({SUPPLIER_SQL})")
def edge_flags(spark, sf_dir):
    return ed.flags(graphs.supplier_graph(spark, sf_dir), THRESHOLD)


@query(f"SELECT count(*) FILTER (w <= {THRESHOLD}) AS n_leq, count(*) FILTER (w > {THRESHOLD}) AS n_gt FROM ({SUPPLIER_SQL})")
def split_counts(spark, sf_dir):
    return ed.split_counts(graphs.supplier_graph(spark, sf_dir), THRESHOLD)


@query(f"SELECT quantile_disc(w, 0.5) AS pivot FROM ({SUPPLIER_SQL})")
def pivot_median(spark, sf_dir):
    return ed.pivot(graphs.supplier_graph(spark, sf_dir))


@query(f"SELECT w AS pivot FROM ({SUPPLIER_SQL}) ORDER BY md5(u || ':' || v || ':' || w || ':0'), u, v, w LIMIT 1")
def pivot_random(spark, sf_dir):
    return ed.random_pivot(graphs.supplier_graph(spark, sf_dir))


@query(f"SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS rank FROM ({PART_SQL})")
def edge_sort_rank(spark, sf_dir):
    return ed.rank(graphs.part_graph(spark, sf_dir))


def _placed(spark: SparkSession, ordered: DataFrame) -> DataFrame:
    """The rows with their place from 1 in the order in which they come."""
    written = Stage(spark, "placed").write(ordered.withColumn("_at", F.monotonically_increasing_id()), "rows")
    return ed.rank(written, ("_at",), "place").drop("_at")


@query(f"SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) AS place FROM ({SUPPLIER_SQL})")
def edge_sort(spark, sf_dir):
    return _placed(spark, ed.sort_edges(graphs.supplier_graph(spark, sf_dir)))


@query(f"SELECT u, v, w, row_number() OVER (ORDER BY u, v) AS place FROM ({SUPPLIER_SQL})")
def edge_sort_endpoints(spark, sf_dir):
    return _placed(spark, ed.sort_endpoints(graphs.supplier_graph(spark, sf_dir)))


@query(f"SELECT u, v, w, (sum(w) OVER (ORDER BY w, u, v))::BIGINT AS scan FROM ({PART_SQL})")
def scan_inclusive(spark, sf_dir):
    return ed.scan(graphs.part_graph(spark, sf_dir), F.col("w"))


@query(f"SELECT u, v, w, (sum(w) OVER (ORDER BY w, u, v) - w)::BIGINT AS scan FROM ({PART_SQL})")
def scan_exclusive(spark, sf_dir):
    return ed.scan(graphs.part_graph(spark, sf_dir), F.col("w"), inclusive=False)


@query(f"SELECT u, v, w, row_number() OVER (ORDER BY w, u, v) - 1 AS pos FROM ({SUPPLIER_SQL}) WHERE w <= {THRESHOLD}")
def compaction_index(spark, sf_dir):
    return ed.compaction_index(graphs.supplier_graph(spark, sf_dir), THRESHOLD)


@query(f"SELECT u, v, w, row_number() OVER (ORDER BY w DESC, u DESC, v DESC) - 1 AS pos FROM ({SUPPLIER_SQL})")
def permutation_gather(spark, sf_dir):
    """Edges in reversed order by way of an index."""
    rows = ed.scan(graphs.supplier_graph(spark, sf_dir), F.lit(1).cast("long"), inclusive=False, name="pos")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    index = rows.select("pos").withColumn("k", F.lit(0)).join(n.withColumn("k", F.lit(0)), "k").select("pos", (F.col("n") - 1 - F.col("pos")).alias("source"))
    return ed.gather(rows, index)


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 3)::INT AS d0, ((l_partkey >> 2) & 3)::INT AS d1, ((l_partkey >> 4) & 3)::INT AS d2 FROM lineitem")
def radix_digits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", *(digit("l_partkey", i).cast("int").alias(f"d{i}") for i in range(3)))


@query(f"SELECT sum(w)::BIGINT AS weight, count(*) AS n_edges FROM ({SUPPLIER_SQL})")
def edge_weight_total(spark, sf_dir):
    return ed.total_weight(graphs.supplier_graph(spark, sf_dir))


@query(f"SELECT count(*) AS n_vertices FROM (SELECT u FROM ({SUPPLIER_SQL}) UNION SELECT v FROM ({SUPPLIER_SQL}))")
def vertex_count(spark, sf_dir):
    return ed.vertices(graphs.supplier_graph(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_vertices"))


@query(f"SELECT u, v, w FROM ({NATION_SQL}) UNION ALL SELECT u, v, w FROM ({SUPPLIER_SQL})")
def edge_append(spark, sf_dir):
    return ed.append(graphs.nation_graph(spark, sf_dir), graphs.supplier_graph(spark, sf_dir))


# Components

_LIGHT = f"SELECT u, v, w FROM ({SUPPLIER_SQL}) WHERE w <= {COMPONENT_WEIGHT}"


def _light_components(spark, sf_dir):
    g = graphs.supplier_graph(spark, sf_dir)
    return g, cc.components(ed.split(g, COMPONENT_WEIGHT)[0])


@query(components_sql(_LIGHT))
def components_below_pivot(spark, sf_dir):
    return _light_components(spark, sf_dir)[1]


@query(f"WITH c AS ({components_sql(_LIGHT)}) SELECT g.u, g.v, g.w FROM ({SUPPLIER_SQL}) g LEFT JOIN c a ON g.u = a.id LEFT JOIN c b ON g.v = b.id "
       f"WHERE coalesce(a.component, g.u) <> coalesce(b.component, g.v) AND g.w > {COMPONENT_WEIGHT}")  # fmt: skip
def filter_connected(spark, sf_dir):
    """Heavy edges that the light edges' components do not close yet."""
    g, labels = _light_components(spark, sf_dir)
    return cc.filter_connected(ed.split(g, COMPONENT_WEIGHT)[1], labels)


_PARENTS = "SELECT s_suppkey AS id, (s_suppkey + 1) // 2 AS parent FROM supplier"


@query(f"WITH p AS ({_PARENTS}), q AS (SELECT p.id, p2.parent FROM p JOIN p p2 ON p.parent = p2.id) SELECT q.id, q2.parent FROM q JOIN q q2 ON q.parent = q2.id")
def pointer_jump_k(spark, sf_dir):
    """Two pointer jumps in a binary tree of supplier keys."""
    parents = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("(s_suppkey + 1) div 2").alias("parent"))
    return cc.pointer_jump(parents, 2)


# Spanning trees


@query(prim_sql(NATION_SQL))
def mst_nation(spark, sf_dir):
    return mst.minimum_spanning_forest(graphs.nation_graph(spark, sf_dir))


@query(prim_sql(SUPPLIER_SQL))
def mst_natsupp(spark, sf_dir):
    return mst.minimum_spanning_forest(graphs.supplier_graph(spark, sf_dir), "boruvka")


@query(prim_sql(SUPPLIER_SQL))
def mst_banded(spark, sf_dir):
    return mst.minimum_spanning_forest(graphs.supplier_graph(spark, sf_dir), "banded", bands=4)


@query(prim_sql(SUPPLIER_SQL))
def mst_adaptive(spark, sf_dir):
    """Filter-Kruskal down to parts of a hundred edges."""
    return mst.adaptive(mst.simple_edges(graphs.supplier_graph(spark, sf_dir)), least_rows=100, depth=8)


@query(f"SELECT sum(w)::BIGINT AS weight, count(*) AS n_edges FROM ({prim_sql(SUPPLIER_SQL)})")
def mst_weight(spark, sf_dir):
    return ed.total_weight(mst.minimum_spanning_forest(graphs.supplier_graph(spark, sf_dir)))


@query()
def mst_partsupp(spark, sf_dir):
    return mst.minimum_spanning_forest(graphs.part_graph(spark, sf_dir))


@query(f"WITH t AS ({prim_sql(NATION_SQL)}) SELECT sum(w)::BIGINT AS weight, (SELECT sum(w)::BIGINT FROM ({NATION_SQL})) AS expected, sum(w) = (SELECT sum(w) FROM ({NATION_SQL})) AS ok FROM t")
def mst_check(spark, sf_dir):
    """The solution check of a tree against a truth that is heavier: the whole graph."""
    g = graphs.nation_graph(spark, sf_dir)
    return mst.check_solution(mst.minimum_spanning_forest(g, "local"), g)


# Timing statistics and files

_TIMINGS = "SELECT event_type AS tag, event_id AS call, value AS seconds FROM events"
_STATS = f"""SELECT tag, round(avg(seconds), 6) AS average, round(sqrt(sum((seconds - m) * (seconds - m))) / count(*), 6) AS std_dev,
    round(max(seconds) FILTER (rn = n // 2 + 1), 6) AS median, round(sum(seconds), 4) AS total, count(*) AS num_calls,
    round(stddev_pop(seconds), 6) AS std_pop, round(quantile_cont(seconds, 0.5), 6) AS true_median
FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY call) AS rn, count(*) OVER (PARTITION BY tag) AS n, avg(seconds) OVER (PARTITION BY tag) AS m FROM ({_TIMINGS})) GROUP BY tag"""
_PLACES = {"average": 6, "std_dev": 6, "median": 6, "total": 4, "std_pop": 6, "true_median": 6}


def _timings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("call"), F.col("value").alias("seconds"))


@query(_STATS)
def timing_stats(spark, sf_dir):
    return stats.timing_stats(_timings(spark, sf_dir)).withColumns({c: F.round(c, n) for c, n in _PLACES.items()})


@query(f"SELECT tag, seconds AS median FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seconds) AS rn, count(*) OVER (PARTITION BY tag) AS n FROM ({_TIMINGS})) WHERE rn = n // 2 + 1")
def timing_upper_median(spark, sf_dir):
    return stats.upper_median(_timings(spark, sf_dir))


@query(f"SELECT tag, round(total, 4) AS total, round(total / sum(total) OVER () * 100, 6) AS share, round(sum(total) OVER (), 4) AS run_total FROM (SELECT tag, sum(seconds) AS total FROM ({_TIMINGS}) GROUP BY tag)")
def share_of_total(spark, sf_dir):
    totals = _timings(spark, sf_dir).groupBy("tag").agg(F.sum("seconds").alias("total"))
    return stats.share_of_total(totals).select("tag", F.round("total", 4).alias("total"), F.round("share", 6).alias("share"), F.round("run_total", 4).alias("run_total"))


@query("SELECT (user_id % 5) AS run, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS \"{t}\"" for t in ("click", "view", "purchase")) + " FROM events GROUP BY 1")
def pivot_report(spark, sf_dir):
    tags = ["click", "view", "purchase"]
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("tag")).agg(F.sum("value").alias("total"))
    out = stats.pivot_report(rows, "run", tags)
    return out.select("run", *(F.round(t, 4).alias(t) for t in tags))


@query("SELECT series, string_agg(n || ':' || m, ',' ORDER BY n) AS points FROM (SELECT event_type AS series, (user_id % 4) AS n, count(*) AS m FROM events GROUP BY 1, 2) GROUP BY series")
def run_times(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), (F.col("user_id") % 4).alias("n")).agg(F.count(F.lit(1)).alias("m"))
    out = stats.run_times(rows, "series", "n", "m")
    return out.select("series", F.array_join(F.transform("points", lambda p: F.concat(p["n"].cast("string"), F.lit(":"), p["value"].cast("string"))), ",").alias("points"))


@query(f"SELECT tag, average, std_dev, median, total, num_calls FROM ({_STATS})")
def timing_file_roundtrip(spark, sf_dir):
    path = f"{Stage(spark, 'files').root}/timings"
    results.write_timings(timing_stats(spark, sf_dir), path)
    return results.read_timings(spark, path)


@query(f"SELECT u, v, w FROM ({NATION_SQL})")
def edge_text_roundtrip(spark, sf_dir):
    path = f"{Stage(spark, 'files').root}/edges"
    edgelist.write_edges(graphs.nation_graph(spark, sf_dir), path, single=True)
    return edgelist.read_edges(spark, path)


@query(f"SELECT count(DISTINCT id) AS num_nodes, (SELECT count(*) FROM ({NATION_SQL})) AS num_edges, 1::BIGINT AS direction FROM (SELECT u AS id FROM ({NATION_SQL}) UNION ALL SELECT v FROM ({NATION_SQL}))")
def edge_text_header(spark, sf_dir):
    path = f"{Stage(spark, 'files').root}/edges"
    edgelist.write_edges(graphs.nation_graph(spark, sf_dir), path)
    return edgelist.read_header(spark, path)


@query(f"SELECT u, v, w FROM ({SUPPLIER_SQL})")
def edge_source_roundtrip(spark, sf_dir):
    """Edges through the data source, written by all tasks and read in pieces of a file."""
    path = f"{Stage(spark, 'files').root}/edges"
    file_sources.write_edge_files(graphs.supplier_graph(spark, sf_dir), path)
    return spark.read.format("edge_file").option("split", 2_000).load(path)


@query(f"SELECT count(DISTINCT id) AS num_nodes, (SELECT count(*) FROM ({SUPPLIER_SQL})) AS num_edges, 1::BIGINT AS direction FROM (SELECT u AS id FROM ({SUPPLIER_SQL}) UNION ALL SELECT v FROM ({SUPPLIER_SQL}))")
def edge_source_header(spark, sf_dir):
    return file_sources.write_edge_files(graphs.supplier_graph(spark, sf_dir), f"{Stage(spark, 'files').root}/edges")


@query("SELECT s_suppkey, 'run_' || s_suppkey || '_' || s_nationkey || '.csv' AS name, 'run_' || s_suppkey || '_' || s_nationkey || '_mst_gt.csv' AS truth FROM supplier")
def run_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("prefix", F.lit("run"))
    named = rows.select("s_suppkey", run_name("prefix", "s_suppkey", "s_nationkey").alias("name"))
    return named.withColumn("truth", truth_path("name"))


# A graph over the customers: each brings ATTACHED edges; an edge's older end is found by following places until a newer end.
ATTACHED = 5
_GROWN_SQL = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS no FROM customer),
e AS MATERIALIZED (SELECT (no - 1) * {ATTACHED} + i AS edge FROM c, range({ATTACHED}) t(i) WHERE no > 0),
t AS (SELECT edge, edge AS spot, NULL::BIGINT AS older FROM e
    UNION ALL
    SELECT edge, CASE WHEN place % 2 = 1 THEN place // 2 END, CASE WHEN before = 0 THEN 0 WHEN place % 2 = 0 THEN place // 2 // {ATTACHED} + 1 END
    FROM (SELECT edge, 2 * {ATTACHED} * (spot // {ATTACHED}) AS before, {number_hash_sql('spot', GRAPH_SEED, '//', 'xor')} % greatest(1, 2 * {ATTACHED} * (spot // {ATTACHED})) AS place FROM t WHERE spot IS NOT NULL AND older IS NULL)
    ),
p AS (SELECT DISTINCT older AS u, edge // {ATTACHED} + 1 AS v FROM t WHERE older IS NOT NULL),
w AS (SELECT u, v, 1 + {number_hash_sql(generate.EDGE_NUMBER, GRAPH_SEED + 1, '//', 'xor')} % 999 AS w FROM p)
SELECT a.id AS u, b.id AS v, w::BIGINT AS w FROM w JOIN c a ON a.no = w.u JOIN c b ON b.no = w.v"""


def _customer_graph(spark, sf_dir):
    return generate.graph_over(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ATTACHED, 1, 1_000, GRAPH_SEED)


@query(_GROWN_SQL)
def generated_graph(spark, sf_dir):
    return _customer_graph(spark, sf_dir)


@query()
def mst_generated(spark, sf_dir):
    return mst.minimum_spanning_forest(_customer_graph(spark, sf_dir))


from . import images  # noqa: E402, F401  registers its queries
