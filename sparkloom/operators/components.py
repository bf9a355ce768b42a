"""Connected components with union-find semantics: every vertex gets its set's least id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

#: Up to this many edges (16 bytes each) one task finds the components at once; the result is the same.
LOCAL_EDGES = 200_000


def _mark(edges: DataFrame) -> tuple:
    """Size and order-free digest of an edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): each vertex with its component's least id, by handing on labels and halving paths."""
    pairs = pd.concat(list(batches), ignore_index=True)
    ids, ends = np.unique(pairs[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):  # roots learn of smaller labels too
            np.minimum.at(new, x, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            break
        label = new
    below = np.flatnonzero(label != np.arange(len(ids)))
    yield pd.DataFrame({"a": ids[below], "b": ids[label[below]]})


def star_forest(edges: DataFrame, u: str = "u", v: str = "v", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex that is not its own component's least id.

    Alternates two rewrites until nothing changes: each vertex hands its larger neighbours
    the least id it knows, then its smaller ones. The work of a round is proportional to
    the edges, minima are combined before the shuffle, and the number of rounds is
    logarithmic, so neither long chains nor hub vertices need special care.
    """
    stage = Stage(edges.sparkSession, "components")
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs, step = stage.write(pairs, "0"), 0
    mark = _mark(pairs)
    if 0 < mark[0] <= local_edges:
        pairs, mark = stage.write(pairs.repartition(1).mapInPandas(_least_labels, pairs.schema), "local"), (0,)
        stage.only("local")
    while mark[0]:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        step += 1
        pairs = stage.write(small.distinct(), str(step))
        stage.drop(str(step - 1))
        last, mark = mark, _mark(pairs)
        if mark == last:
            break
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every endpoint of ``edges``; self-loops make a component of one."""
    ids = edges.select(F.explode(F.array(F.col(u).cast("long"), F.col(v).cast("long"))).alias("id")).distinct()
    return ids.join(star_forest(edges, u, v), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def filter_connected(edges: DataFrame, labels: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """The edges whose ends are in different components; unlabelled vertices are their own."""
    ends = edges
    for end, name in ((u, "__cu"), (v, "__cv")):
        ends = ends.join(labels.select(F.col("id").alias(f"{name}_id"), F.col("component").alias(name)), F.col(end) == F.col(f"{name}_id"), "left").withColumn(
            name, F.coalesce(F.col(name), F.col(end).cast("long"))
        )
    return ends.where(F.col("__cu") != F.col("__cv")).select(*edges.columns)


def pointer_jump(parents: DataFrame, times: int = 1) -> DataFrame:
    """(id, parent) after replacing every parent by its parent ``times`` times."""
    for _ in range(times):
        up = parents.select(F.col("id").alias("__p"), F.col("parent").alias("__g"))
        parents = parents.join(up, F.col("parent") == F.col("__p"), "left").select("id", F.coalesce("__g", "parent").alias("parent"))
    return parents
