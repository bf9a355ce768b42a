"""Splits, sorts, scans and totals over edge tables (u, v, w)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from sparkloom.staging import Stage

ORDER = ("w", "u", "v")


def split(edges: DataFrame, threshold, weight: str = "w") -> tuple[DataFrame, DataFrame]:
    """(rows with weight <= threshold, the others); null weights are in neither."""
    return edges.where(F.col(weight) <= threshold), edges.where(F.col(weight) > threshold)


def flags(edges: DataFrame, threshold, weight: str = "w") -> DataFrame:
    low = F.col(weight) <= threshold
    return edges.withColumns({"is_leq": low.cast("int"), "is_gt": (~low).cast("int")})


def split_counts(edges: DataFrame, threshold, weight: str = "w") -> DataFrame:
    return edges.agg(F.count_if(F.col(weight) <= threshold).alias("n_leq"), F.count_if(F.col(weight) > threshold).alias("n_gt"))


def pivot(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(pivot): the lower median weight, one row (null if there is none).

    Rows are counted by weight before anything is ordered, so a weight that most rows share is one row of the scan.
    """
    counts = edges.select(F.col(weight).alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = Stage(edges.sparkSession, "pivot").write(counts, "counts")
    middle = counts.agg(F.expr("(sum(n) + 1) div 2")).first()[0]
    placed = scan(counts, F.col("n"), ("w",), name="upto")
    return placed.where((F.col("upto") >= F.lit(middle)) & (F.col("upto") - F.col("n") < F.lit(middle))).agg(F.max("w").alias("pivot"))


def random_pivot(edges: DataFrame, seed: int = 0, weight: str = "w") -> DataFrame:
    """(pivot): weight of a random row; a top-1 by the MD5 of its columns and the seed, so reruns agree."""
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in edges.columns), F.lit(str(seed))).cast("binary"))
    return edges.orderBy(digest, *edges.columns).limit(1).select(F.col(weight).alias("pivot"))


def sort_edges(edges: DataFrame) -> DataFrame:
    """By weight, ties by endpoints: one strict order for every use."""
    return edges.orderBy(*ORDER)


def sort_endpoints(edges: DataFrame) -> DataFrame:
    return edges.orderBy("u", "v")


def scan(rows: DataFrame, value: Column, order: tuple[str, ...] = ORDER, inclusive: bool = True, name: str = "scan") -> DataFrame:
    """Global prefix sums of ``value`` in ``order`` with one shuffle.

    Rows are range-partitioned and sorted by the order, and a task adds up as it writes; then each
    range is shifted by the total of those before it, from a table of one row a range. Rows that tie in the whole
    order may lie in several ranges, and get their sums in any order among themselves. Sums
    are 64-bit integers or doubles; a null value adds nothing.
    """
    whole = rows.select(F.lit(1).alias("k"), value.alias("x")).schema["x"].dataType.typeName() in ("long", "integer", "short", "byte", "boolean")
    kind, number = ("long", np.int64) if whole else ("double", np.float64)
    stage = Stage(rows.sparkSession, "scan")
    carried = rows.withColumn("__x", F.coalesce(value.cast(kind), F.lit(0).cast(kind)))
    dealt = carried.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, total = TaskContext.get().partitionId(), number(0)
        for batch in batches:
            sums = total + np.cumsum(batch.column("__x").to_numpy().astype(number))
            total = sums[-1] if len(sums) else total
            yield batch.append_column("__range", pa.array(np.full(len(sums), task, np.int32))).append_column("__sum", pa.array(sums))

    schema = StructType([*carried.schema.fields, StructField("__range", IntegerType()), StructField("__sum", LongType() if whole else DoubleType())])
    ranged = stage.write(dealt.mapInArrow(run, schema), "ranged")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.sum("__x").alias("__total")).select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    total = F.col("__sum") + F.col("__start")
    # One row for each range of the sort.
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, total if inclusive else total - F.col("__x")).drop("__x", "__range", "__start", "__sum")


def rank(edges: DataFrame, order: tuple[str, ...] = ORDER, name: str = "rank") -> DataFrame:
    """Row number from 1 in the strict order."""
    return scan(edges, F.lit(1).cast("long"), order, name=name)


def compaction_index(edges: DataFrame, threshold) -> DataFrame:
    """The rows at or under the threshold with the place each takes in the compacted table."""
    flagged = scan(edges, (F.col("w") <= threshold).cast("long"), inclusive=False, name="pos")
    return flagged.where(F.col("w") <= threshold)


def gather(rows: DataFrame, permutation: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows (pos, ...) reordered: place i gets the row at permutation's ``source``."""
    moved = rows.withColumnRenamed(pos, "source")
    return permutation.join(moved, "source").drop("source")


def total_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.sum(F.col("w").cast("long")), F.lit(0)).alias("weight"), F.count(F.lit(1)).alias("n_edges"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def append(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more)
