"""The histogram and timing operators over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_histogram(stream: DataFrame, color: str = "color") -> DataFrame:
    """(bucket, n) so far; state is one row a bucket. Fill empty buckets where it is read."""
    return stream.groupBy(F.col(color).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def windowed_timings(stream: DataFrame, ts: str, length: str, late: str) -> DataFrame:
    """Average, total and number of calls by tag and event-time window; rows later than ``late`` are left out."""
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("window"), "tag")
    return windows.agg(F.avg("seconds").alias("average"), F.sum("seconds").alias("total"), F.count(F.lit(1)).alias("num_calls"))
