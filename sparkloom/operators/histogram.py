"""Dense histograms: every bucket of the range has a row, counted or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def histogram(rows: DataFrame, color: str = "color", by: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """(by ..., bucket, n): partial counts in every task, one final count per bucket.

    Values outside the range are not counted. With ``by``, each group of the input has all
    its buckets.
    """
    counts = rows.groupBy(*by, F.col(color).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    bucket, n = F.col("bucket"), F.col("n")
    # The counts of a group, at most one for each bucket, make a map from which all its buckets are read.
    known = F.collect_list(F.when(bucket.between(0, buckets - 1), F.struct(bucket, n)))
    groups = counts.groupBy(*by).agg(F.map_from_entries(known).alias("known"))
    dense = groups.select(*by, "known", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return dense.select(*by, "bucket", F.coalesce(F.try_element_at("known", bucket), F.lit(0)).cast("long").alias("n"))


def conditional_histogram(rows: DataFrame, color: str = "color", buckets: int = BUCKETS, width: int = 32) -> DataFrame:
    """The same by conditional counts, in a single pass.

    A row adds to one of ``width`` counters of its stretch of buckets; more counters in one
    aggregate would not be compiled.
    """
    at = F.col(color).cast("int")
    stretches = -(-buckets // width)
    counted = rows.where(at.between(0, buckets - 1)).groupBy(F.expr(f"cast(`{color}` AS int) div {width}").cast("int").alias("stretch")).agg(*(F.count_if(at % width == i).alias(f"b{i}") for i in range(width)))
    known = F.map_from_entries(F.collect_list(F.struct("stretch", F.array(*(f"b{i}" for i in range(width))).alias("n"))))
    whole = counted.agg(known.alias("known"))  # at most buckets / width rows
    bucket = F.col("bucket")
    dense = whole.select("known", F.explode(F.sequence(F.lit(0), F.lit(min(buckets, stretches * width) - 1))).alias("bucket"))
    return dense.select("bucket", F.coalesce(F.try_element_at(F.try_element_at("known", F.floor(bucket / width).cast("int")), bucket % width + 1), F.lit(0)).cast("long").alias("n"))


def channels(pixels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(color): all the named channels' bytes as one stream."""
    return pixels.select(F.explode(F.array(*names)).alias("color"))


def differences(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Rows where two histograms disagree or one lacks the bucket."""
    joined = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on], "full")
    return joined.where(~F.col("a.n").eqNullSafe(F.col("b.n"))).select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in on), F.col("a.n").alias("left_n"), F.col("b.n").alias("right_n"))


def verify(a: DataFrame, b: DataFrame) -> None:
    """Stops with an error if the histograms disagree."""
    if not (bad := differences(a, b).limit(5).collect()):
        return
    raise AssertionError(f"histograms differ: {bad}")
