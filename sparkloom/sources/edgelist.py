"""Edge files: ``;``-separated rows, one ``H;nodes;edges;direction`` and many ``E;u;v;w``."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "tag STRING, a LONG, b LONG, c LONG"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all tags; text where a number should be stops the read."""
    return spark.read.csv(path, sep=";", schema=RECORD, mode="FAILFAST")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, w); other tags are skipped by a filter that the scan takes over."""
    return _records(spark, path).where("tag = 'E'").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("w"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path).where("tag = 'H'").select(F.col("a").alias("num_nodes"), F.col("b").alias("num_edges"), F.col("c").alias("direction"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark opens."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def check_header(spark: SparkSession, path: str) -> None:
    """Stops if the header's number of edges is not the number of rows."""
    header, n = read_header(spark, path).head(2), read_edges(spark, path).count()
    if len(header) != 1 or header[0]["num_edges"] != n:
        raise ValueError(f"{path}: header {header} but {n} edges")


def sorted_graph(spark: SparkSession, path: str) -> DataFrame:
    return read_edges(spark, path).orderBy("u", "v")


def edge_projection(graph: DataFrame) -> DataFrame:
    """(source, target, weight) as (u, v, w) by endpoints."""
    return graph.withColumnsRenamed({"source": "u", "target": "v", "weight": "w"}).select("u", "v", "w").orderBy("u", "v")


def edge_lines(edges: DataFrame) -> DataFrame:
    """(no, line): the file's rows, the header with the true vertex count first."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).agg(F.countDistinct("id").alias("nodes")).withColumn("k", F.lit(0))
    count = edges.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    header = nodes.join(count, "k").select(F.lit(0).alias("no"), F.concat_ws(";", F.lit("H"), "nodes", "n", F.lit(1)).alias("line"))
    return header.unionByName(edges.select(F.lit(1).alias("no"), F.concat_ws(";", F.lit("E"), "u", "v", "w").alias("line")))


def write_edges(edges: DataFrame, path: str, single: bool = False) -> None:
    """Write the file's rows, a part for each task, in no order; the reader does not mind.

    ``single`` makes one file with the header on top, for small tables.
    """
    lines = edge_lines(edges)
    (lines.coalesce(1).sortWithinPartitions("no") if single else lines).select("line").write.mode("overwrite").text(path)


def truth_path(path: str) -> str:
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_mst_gt{p.suffix}"))


def input_path(root: str, name: str) -> str:
    """Place of a named input; a path with a folder or a scheme stays as it is."""
    return name if "/" in name else str(PurePosixPath(root) / "input_data" / name)


def output_path(root: str, name: str, reference: bool = False) -> str:
    return str(PurePosixPath(root) / "output" / (f"{name}_ref.csv" if reference else f"{name}.csv"))
