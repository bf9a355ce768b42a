"""Statistics of timing series (tag, call, seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .edges import scan

#: Places of the middle of _n rows.
LOWER, UPPER = "(_n + 1) div 2", "_n div 2 + 1"


def _at_places(rows: DataFrame, by: tuple[str, ...], places: Column) -> DataFrame:
    """(_tag, seconds): of each tag's rows in the order of ``by`` those at ``places`` (an array, from 1; _n is the tag's number of rows).

    Equal rows are counted before they are ordered, and the counts are added up over range
    partitions: neither a tag nor a value that most calls share is ordered in one task.
    """
    counts = rows.groupBy("tag", *by).agg(F.count(F.lit(1)).alias("_c"))
    counts = Stage(rows.sparkSession, "places").write(counts, "counts")
    sizes = counts.groupBy("tag").agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("tag").rowsBetween(Window.unboundedPreceding, -1))  # one row a tag
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0))).withColumnRenamed("tag", "_tag")
    placed = scan(counts, F.col("_c"), ("tag", *by), name="_upto").join(starts, F.col("tag").eqNullSafe(F.col("_tag")))
    last = F.col("_upto") - F.col("_start")
    wanted = placed.withColumn("_k", F.explode(F.array_distinct(places))).where((F.col("_k") <= last) & (F.col("_k") > last - F.col("_c")))
    return wanted.select("_tag", "seconds")


def timing_stats(timings: DataFrame) -> DataFrame:
    """(tag, average, std_dev, median, total, num_calls, std_pop, true_median).

    std_dev is the root of the summed squares over the number of calls, and median the
    middle call's value in call order, as timing files have them; std_pop and true_median
    are the usual ones.
    """
    rows = timings.select("tag", "call", "seconds")
    middle = _at_places(rows, ("call", "seconds"), F.array(F.expr(UPPER))).select(F.col("_tag").alias("_a"), F.col("seconds").alias("median"))
    middles = _at_places(rows.where("seconds IS NOT NULL"), ("seconds",), F.array(F.expr(LOWER), F.expr(UPPER)))
    true = middles.groupBy(F.col("_tag").alias("_b")).agg(F.avg("seconds").alias("true_median"))
    sums = rows.groupBy("tag").agg(
        F.avg("seconds").alias("average"), (F.stddev_pop("seconds") / F.sqrt(F.count("seconds"))).alias("std_dev"), F.sum("seconds").alias("total"),
        F.count(F.lit(1)).alias("num_calls"), F.stddev_pop("seconds").alias("std_pop"),
    )
    joined = sums.join(middle, F.col("tag").eqNullSafe(F.col("_a"))).join(true, F.col("tag").eqNullSafe(F.col("_b")), "left")
    return joined.select("tag", "average", "std_dev", "median", "total", "num_calls", "std_pop", "true_median")


def upper_median(timings: DataFrame) -> DataFrame:
    """(tag, median): of an even number of calls the higher middle one."""
    return _at_places(timings.select("tag", "seconds"), ("seconds",), F.array(F.expr(UPPER))).select(F.col("_tag").alias("tag"), F.col("seconds").alias("median"))


def share_of_total(rows: DataFrame, value: str = "total", by: tuple[str, ...] = (), at_100: bool = True) -> DataFrame:
    """Each row's share of its run's total, and that total."""
    whole = F.sum(value).over(Window.partitionBy(*by))
    return rows.withColumns({"share": F.col(value) / whole * (100.0 if at_100 else 1.0), "run_total": whole})


def pivot_report(rows: DataFrame, run: str, tags: list[str], value: str = "total") -> DataFrame:
    """One row a run, one column a tag."""
    return rows.groupBy(run).pivot("tag", tags).agg(F.first(value))


def run_times(rows: DataFrame, series: str, n: str, value: str = "median") -> DataFrame:
    """(series, points): (n, value) pairs of a series in the order of n."""
    return rows.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(value).alias("value")))).alias("points"))
