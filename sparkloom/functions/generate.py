"""Synthetic colours and graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.edges import scan
from sparkloom.staging import Stage

from .scalars import HASH_FACTORS, HASH_MODULUS, number_hash

COLORS = 256
#: An edge's number for its weight.
EDGE_NUMBER = "u * 1000003 + v"


def round_robin_colors(spark: SparkSession, n: int, k: int = 2) -> DataFrame:
    """(pos, color): colours 0 ... k - 1 in turn."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % k).cast("int").alias("color"))


def random_colors(spark: SparkSession, n: int, k: int = COLORS, seed: int = 0) -> DataFrame:
    """(pos, color): a hash of position and seed, so that retried tasks agree."""
    return spark.range(n).select(F.col("id").alias("pos"), colors_of("id", k, seed).alias("color"))


def colors_of(key: str, k: int = COLORS, seed: int = 0) -> Column:
    """A random colour below ``k`` for each value of a whole-number column."""
    return (number_hash(key, seed) % k).cast("int")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """``scalars.number_hash`` of an array."""
    p, (f, g, h) = HASH_MODULUS, HASH_FACTORS
    one = (x % p * f + x // p * g + seed + 1) % p
    low = ((one ^ (one >> 13)) * h + 12345) % p
    return ((low ^ (low >> 7)) * g + 777) % p * (p + 1) + low


def attached_to(edge: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """The older end of each edge of a graph grown by preferential attachment.

    Edge i is brought by vertex i // m + 1 and ends at the vertex that a random place in the
    list of all ends before that vertex holds, so vertices are found in proportion to their
    degree. Every other place is a newer end and known; the rest are older ends of earlier
    edges, found in the same way. Nothing is shared between edges but the seed.
    """
    out, todo, at = np.zeros(len(edge), np.int64), np.arange(len(edge)), edge.astype(np.int64)
    while len(todo):
        before = 2 * m * (at // m)  # places that stood before the vertex came
        place = np.where(before > 0, _mixed(at, seed) % np.maximum(before, 1), -1)
        newer = (place >= 0) & (place % 2 == 0)
        out[todo[newer]] = place[newer] // 2 // m + 1
        more = (place >= 0) & ~newer  # the first vertex's edges end at vertex 0
        todo, at = todo[more], place[more] // 2
    return out


def weighted_graph(spark: SparkSession, n: int, m: int, w_min: int = 0, w_max: int = 100, seed: int = 0) -> DataFrame:
    """(u, v, w) of a connected preferential-attachment graph of n vertices, weights in [w_min, w_max).

    Each vertex after the first brings m edges; those that meet the same vertex are one edge.
    Every task makes its own edges, and weights are hashes of the edge, so retried tasks agree.
    """
    return _grown(spark.range(max(0, n - 1) * m), m, w_min, w_max, seed)


def _grown(edges: DataFrame, m: int, w_min: int, w_max: int, seed: int) -> DataFrame:
    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            edge = b["id"].to_numpy()
            yield pd.DataFrame({"u": attached_to(edge, m, seed), "v": edge // m + 1})

    pairs = edges.mapInPandas(grow, "u long, v long").distinct()
    weight = F.lit(w_min) + number_hash(EDGE_NUMBER, seed + 1) % (w_max - w_min)
    return pairs.select("u", "v", weight.cast("long").alias("w"))


def graph_over(vertices: DataFrame, m: int, w_min: int = 0, w_max: int = 100, seed: int = 0) -> DataFrame:
    """The same graph over the ids of a table (id), which come in their order; ids are distinct.

    A vertex's number is its rank, the ids' edges are made where the rows are, and ids take the
    numbers' places by joins.
    """
    stage = Stage(vertices.sparkSession, "graph-over")
    numbered = stage.write(scan(vertices.select("id"), F.lit(1).cast("long"), ("id",), inclusive=False, name="no"), "numbered")
    edges = numbered.where("no > 0").select(F.explode(F.sequence((F.col("no") - 1) * m, F.col("no") * m - 1)).alias("id"))
    grown = stage.write(_grown(edges, m, w_min, w_max, seed), "grown")
    for end in ("u", "v"):
        name = numbered.select(F.col("id").alias("__id"), F.col("no").alias(end))
        grown = grown.join(name, end).drop(end).withColumnRenamed("__id", end)
    return grown.select("u", "v", "w")
