"""Minimum spanning forests under the strict order (w, u, v), which makes them unique."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .components import star_forest
from .edges import pivot

#: "auto" works in tasks up to this many vertices: a task's forest has fewer edges than that.
LOCAL_VERTICES = 300_000
#: Edges that a task holds before it thins them.
HELD_EDGES = 300_000
#: Edges of a range that is thinned before rounds of joins; fewer edges are not thinned.
RANGE_EDGES = 500_000
#: Parts of fewer edges are not split by the adaptive strategy.
LEAST_ROWS = 100_000


def simple_edges(edges: DataFrame) -> DataFrame:
    """u < v, no loops, the lightest of parallel edges; nulls go."""
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    return edges.where(u != v).where("w IS NOT NULL").groupBy(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).agg(F.min(F.col("w").cast("long")).alias("w"))


def forest_rows(u: np.ndarray, v: np.ndarray, w: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
    """Indices of the forest's edges; ``a`` and ``b`` are the ends if these are groups of vertices.

    Each round every component takes its first outgoing edge in the strict order; all of an
    array's rounds are whole-array operations.
    """
    order = np.lexsort((v, u, w))
    ids, ends = np.unique(np.concatenate([u if a is None else a, v if b is None else b])[np.concatenate([order, order + len(u)])], return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    component, at, taken = np.arange(len(ids)), np.arange(len(u)), []
    while True:
        ca, cb = component[a[at]], component[b[at]]
        out = ca != cb
        at, ca, cb = at[out], ca[out], cb[out]
        if not len(at):
            break
        first = np.full(len(ids), len(at))
        place = np.arange(len(at))
        np.minimum.at(first, ca, place)
        np.minimum.at(first, cb, place)
        roots = np.flatnonzero(first < len(at))
        pick = first[roots]
        taken.append(at[np.unique(pick)])
        parent = np.arange(len(ids))
        parent[roots] = np.where(ca[pick] == roots, cb[pick], ca[pick])
        mutual = roots[(parent[parent[roots]] == roots) & (roots < parent[roots])]
        parent[mutual] = mutual
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        component = parent[component]
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)


def _local(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """A partition's forest; held edges are thinned whenever they have doubled, so each is sorted a few times only."""
    held: list[pd.DataFrame] = []
    size, most = 0, HELD_EDGES

    def thinned() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        return rows.iloc[forest_rows(*(rows[c].to_numpy() for c in columns))]

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size > most:
            held = [thinned()]
            size = len(held[0])
            most = max(HELD_EDGES, 2 * size)
    if size:
        yield thinned()


def _ranges_thinned(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """A partition's edges without those that are heaviest on a cycle of the edges held with them.

    A forest that takes more than half of what a task holds leaves it, so memory doesn't grow with the partition.
    """
    held: list[pd.DataFrame] = []
    size = 0

    def thinned() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        return rows.iloc[forest_rows(*(rows[c].to_numpy() for c in columns))]

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size > HELD_EDGES:
            rows = thinned()
            held, size = [rows], len(rows)
            if size > HELD_EDGES // 2:
                yield rows
                held, size = [], 0
    if size:
        yield thinned()


def _thinned(edges: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """``edges`` without most of those that close a cycle: a range of vertices meets in a task, a hub's edges in several."""
    n = edges.count()
    if n <= RANGE_EDGES:
        return edges
    columns = tuple(dict.fromkeys(("u", "v", "w", *ends)))
    ranges = edges.select(*columns).repartitionByRange(n // RANGE_EDGES + 1, *ends).sortWithinPartitions(*ends)
    return ranges.mapInPandas(lambda b: _ranges_thinned(b, columns), ranges.schema)


def _fits(edges: DataFrame, a: str, b: str, most: int) -> bool:
    """Whether there are about ``most`` vertices or fewer; a sketch decides, as either way finds the same forest."""
    return edges.select(F.explode(F.array(a, b)).alias("id")).agg(F.approx_count_distinct("id", 0.02)).first()[0] <= most


def _reduced(edges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Forests of partitions, then of ever fewer: an edge that is heaviest on a local cycle is in no forest."""
    run = lambda b: _local(b, columns)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.mapInPandas(run, edges.schema)
    while parts > 1:
        parts = max(1, parts // 16)
        edges = edges.repartition(parts).mapInPandas(run, edges.schema)
    return edges


def boruvka(edges: DataFrame, ends: tuple[str, str] = ("u", "v")) -> DataFrame:
    """Rounds of joins for vertex sets that outgrow a task; components at least halve in a round.

    ``ends`` are the columns of the edges' ends where these are groups of vertices. Ranges
    of many edges are thinned by tasks first.
    """
    stage, step = Stage(edges.sparkSession, "boruvka"), 0
    live = stage.write(_thinned(edges, ends).select(F.col(ends[0]).alias("cu"), F.col(ends[1]).alias("cv"), "w", "u", "v").where("cu <> cv"), "live0")
    picked = None
    while not live.isEmpty():
        step += 1
        sides = live.select(F.col("cu").alias("c"), F.struct("w", "u", "v", F.col("cv").alias("other")).alias("e")).union(
            live.select(F.col("cv").alias("c"), F.struct("w", "u", "v", F.col("cu").alias("other")).alias("e"))
        )
        best = stage.write(sides.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"), f"best{step}")
        new = best.select("u", "v", "w").distinct()
        picked = new if picked is None else picked.unionByName(new)
        labels = stage.write(star_forest(best, "c", "other"), f"labels{step}")
        for end in ("cu", "cv"):
            names = labels.select(F.col("id").alias("__id"), F.col("component").alias("__to"))
            live = live.join(names, F.col(end) == F.col("__id"), "left").withColumn(end, F.coalesce("__to", end)).drop("__id", "__to")
        live = stage.write(live.where("cu <> cv"), f"live{step}")
        stage.drop(f"live{step - 1}")
    return picked if picked is not None else edges.select("u", "v", "w").limit(0)


def _forest(part: DataFrame, local_vertices: int) -> DataFrame:
    """The forest (u, v, w, a, b) of edges whose ends are the groups of vertices a and b."""
    if _fits(part, "a", "b", local_vertices):
        return _reduced(part, ("u", "v", "w", "a", "b"))
    found = boruvka(part, ("a", "b"))
    return part.join(found, ["u", "v", "w"], "left_semi")


def _contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges with a and b replaced by their labels, if they have one; those inside one component go."""
    for end in ("a", "b"):
        names = labels.select(F.col("id").alias("__id"), F.col("component").alias("__to"))
        edges = edges.join(names, F.col(end) == F.col("__id"), "left").withColumn(end, F.coalesce("__to", end)).drop("__id", "__to")
    return edges.where("a <> b").select("u", "v", "w", "a", "b")


def _continued(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after more links between its components; neither they nor the links are labelled anew.

    Only vertices that are not their component's least have a row, so a link's end has none.
    """
    new = star_forest(links, "a", "b")
    if labels is None:
        return new
    to = new.select(F.col("id").alias("__id"), F.col("component").alias("__to"))
    moved = labels.join(to, F.col("component") == F.col("__id"), "left").select("id", F.coalesce("__to", "component").alias("component"))
    return moved.unionByName(new)


def banded(edges: DataFrame, bands: int = 8, local_vertices: int = LOCAL_VERTICES) -> DataFrame:
    """Light bands of weights first; edges inside components that lighter bands made never reach a sort.

    Cut points are quantiles of the distinct weights, so a band of one weight is the least
    there can be and the loop ends. The edges are dealt into bands by one write, and a band
    reads its own alone. A band whose ends outgrow a task goes by rounds of joins.
    """
    if bands < 1:
        raise ValueError("bands must be at least 1")
    stage = Stage(edges.sparkSession, "banded")
    shares = [i / bands for i in range(1, bands)]
    cuts = edges.select("w").distinct().agg(F.percentile_approx("w", shares, 10_000).alias("c")).first()["c"] if shares else []
    tops = sorted(set(cuts or []))
    number = F.lit(0)
    for top in tops:
        number = number + (F.col("w") > top).cast("int")
    where = f"{stage.root}/bands"
    edges.select("u", "v", "w", number.alias("band")).write.partitionBy("band").parquet(where)
    dealt = edges.sparkSession.read.schema("u long, v long, w long, band int").parquet(where)
    labels, parts = None, []
    for i in range(len(tops) + 1):
        band = dealt.where(F.col("band") == i).select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b"))
        band = stage.write(_contracted(band, labels) if labels is not None else band, f"band{i}")
        parts.append(stage.write(_forest(band, local_vertices), f"tree{i}"))
        stage.drop(f"band{i}")
        if i < len(tops):
            labels = stage.write(_continued(labels, parts[-1]), f"labels{i}")
    return _union(parts).select("u", "v", "w")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def adaptive(edges: DataFrame, least_rows: int = LEAST_ROWS, depth: int = 32, local_vertices: int = LOCAL_VERTICES) -> DataFrame:
    """Filter-Kruskal: split at the part's own median weight, solve the light side, then what it leaves of the heavy one.

    A part of fewer rows than ``least_rows``, or than a ``depth``-th of this call's edges, or
    of one weight, is solved as a whole; so at most about 2 * ``depth`` parts are. A part is written by its
    split, and a heavy side again after its filter, by which it shrinks to the edges between
    the light side's components; of parallel ones the first stays.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    stage, numbers = Stage(edges.sparkSession, "adaptive"), count()
    whole = stage.write(edges.select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")), "edges")
    cutoff = max(least_rows, whole.count() // depth)

    def solve(part: DataFrame, name: str) -> list[DataFrame]:
        n, low, high = part.agg(F.count(F.lit(1)), F.min("w"), F.max("w")).first()
        if not n:
            return []
        if n < cutoff or low == high:
            found = [stage.write(_forest(part, local_vertices), f"tree{next(numbers)}")]
            stage.drop(name)
            return found
        cut = pivot(part).first()["pivot"]
        light = F.col("w") <= cut if cut < high else F.col("w") < cut  # either side has rows
        number = next(numbers)
        where = f"{stage.root}/split{number}"
        part.withColumn("light", light).write.partitionBy("light").parquet(where)
        stage.drop(name)
        sides = edges.sparkSession.read.schema("u long, v long, w long, a long, b long, light boolean").parquet(where)
        mine = stage.write(sides.where("light").drop("light"), f"light{number}")
        found = solve(mine, f"light{number}")
        between = _contracted(sides.where("NOT light").drop("light"), stage.write(star_forest(_union(found), "a", "b"), f"labels{number}"))
        first = between.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        heavy = stage.write(first.select("e.u", "e.v", "e.w", "a", "b"), f"heavy{number}")
        stage.drop(f"split{number}")
        stage.drop(f"labels{number}")
        return found + solve(heavy, f"heavy{number}")

    found = solve(whole, "edges")
    return _union(found).select("u", "v", "w") if found else edges.select("u", "v", "w").limit(0)


def minimum_spanning_forest(edges: DataFrame, strategy: str = "auto", bands: int = 8) -> DataFrame:
    """(u, v, w) of the forest; strategies "local", "boruvka", "banded" and "adaptive" agree edge by edge.

    "auto" counts vertices: tasks hold forests, never all edges, so "local" fits while a
    forest fits a task; beyond that tasks thin ranges of edges and rounds of joins take over.
    """
    if strategy not in ("auto", "local", "boruvka", "banded", "adaptive"):
        raise ValueError(f"unknown strategy {strategy!r}")
    edges = Stage(edges.sparkSession, "mst").write(simple_edges(edges), "edges")
    if strategy == "auto":
        strategy = "local" if _fits(edges, "u", "v", LOCAL_VERTICES) else "boruvka"
    if strategy == "boruvka":
        return boruvka(edges)
    if strategy == "banded":
        return banded(edges, bands)
    if strategy == "adaptive":
        return adaptive(edges)
    return _reduced(edges, ("u", "v", "w"))


def check_solution(tree: DataFrame, truth: DataFrame) -> DataFrame:
    """(weight, expected, ok), one row."""
    a, b = (t.agg(F.coalesce(F.sum("w"), F.lit(0)).alias(n)) for t, n in ((tree, "weight"), (truth, "expected")))
    return a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k").select("weight", "expected", (F.col("weight") == F.col("expected")).alias("ok"))
