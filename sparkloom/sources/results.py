"""Timing files and histogram result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMINGS = "tag STRING, average DOUBLE, std_dev DOUBLE, median DOUBLE, total DOUBLE, num_calls LONG"
RUNTIMES = "kernel STRING, input STRING, runtime DOUBLE"


def write_timings(stats: DataFrame, path: str) -> None:
    """One ``;``-separated file with header, tags in their order; a row a tag, so one task."""
    stats.select("tag", "average", "std_dev", "median", "total", "num_calls").orderBy("tag").coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema=TIMINGS)


def print_timings(stats: DataFrame) -> None:
    stats.orderBy("tag").show(truncate=False)


def append_runtimes(rows: DataFrame, path: str, first: bool = False) -> None:
    """Add (kernel, input, runtime) rows; ``first`` starts the result anew."""
    rows.select("kernel", "input", F.col("runtime").cast("double")).write.mode("overwrite" if first else "append").csv(path, header=True)


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RUNTIMES)
