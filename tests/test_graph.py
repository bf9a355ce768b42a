import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.generate import attached_to, weighted_graph
from sparkloom.operators import components as cc
from sparkloom.operators import edges as ed
from sparkloom.operators import mst, stats
from sparkloom.sources import edgelist

GOLDEN = "0-1:3, 0-3:6, 0-5:9, 1-3:4, 1-2:2, 1-4:9, 1-5:9, 2-3:2, 2-4:8, 2-6:9, 3-6:9, 4-6:7, 4-8:9, 4-9:10, 4-5:8, 5-9:18, 6-7:4, 6-8:5, 7-8:1, 8-9:3, 7-9:4"
GOLDEN_TREE = "0-1:3, 1-2:2, 2-3:2, 2-4:8, 4-6:7, 4-5:8, 6-7:4, 7-8:1, 8-9:3"
SCHEMA = "u long, v long, w long"


def parsed(text):
    return [(int(u), int(v), int(w)) for e in text.split(", ") for p, w in [e.split(":")] for u, v in [p.split("-")]]


def kruskal(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    tree = set()
    for w, u, v in sorted({(w, min(u, v), max(u, v)) for u, v, w in edges if u != v}):
        if root(u) != root(v):
            parent[root(u)] = root(v)
            tree.add((u, v, w))
    return tree


CASES = {
    "golden": parsed(GOLDEN),
    "one": [(3, 9, 5)],
    "loop": [(1, 1, 4), (1, 2, 7)],
    "parallel": [(1, 2, 9), (2, 1, 3), (1, 2, 3), (2, 3, 1)],
    "equal weights": [(i, j, 7) for i in range(8) for j in range(i + 1, 8)],
    "forest": [(0, 1, 5), (1, 2, 5), (10, 11, 1), (11, 12, 2), (10, 12, 3)],
    "negative and large": [(0, 1, -5), (1, 2, 2**31 + 5), (0, 2, 2**30), (2, 3, -(2**30))],
    "far ids": [(10**12, 5, 1), (5, 10**15, 2), (10**12, 10**15, 3)],
    "random": [(random.Random(i).randrange(40), random.Random(i + 999).randrange(40), random.Random(i + 5).randrange(9)) for i in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_forests_agree_with_kruskal(spark, name):
    df = spark.createDataFrame(CASES[name], SCHEMA)
    want = kruskal(CASES[name])
    got = {tuple(r) for r in mst.adaptive(mst.simple_edges(df), least_rows=2, depth=4, local_vertices=1 if name == "random" else 10**6).collect()}
    assert got == want
    for strategy in ("local", "boruvka") + (("banded",) if name in ("golden", "equal weights", "forest") else ()):
        got = {tuple(r) for r in mst.minimum_spanning_forest(df, strategy, bands=3).select("u", "v", "w").collect()}
        assert got == want, strategy
    if name == "golden":
        assert want == set(parsed(GOLDEN_TREE)) and sum(w for _, _, w in want) == 38


def test_empty_graph(spark):
    df = spark.createDataFrame([], SCHEMA)
    for strategy in ("local", "boruvka", "banded", "adaptive"):
        assert mst.minimum_spanning_forest(df, strategy).count() == 0
    assert cc.components(df).count() == 0


def test_forest_rows_of_a_large_array():
    rng = np.random.default_rng(1)
    u, v, w = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000), rng.integers(0, 50, 5000)
    keep = u != v
    u, v, w = np.minimum(u, v)[keep], np.maximum(u, v)[keep], w[keep]
    at = mst.forest_rows(u, v, w)
    assert {(int(u[i]), int(v[i]), int(w[i])) for i in at} == kruskal(list(zip(u.tolist(), v.tolist(), w.tolist())))


def test_strategy_names(spark):
    df = spark.createDataFrame(CASES["one"], SCHEMA)
    with pytest.raises(ValueError):
        mst.minimum_spanning_forest(df, "other")
    with pytest.raises(ValueError):
        mst.banded(df, 0)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(301)} == {1000} and got[5000] == 5000


def test_split_and_filter(spark):
    df = spark.createDataFrame([(i, i - 10, i) for i in range(10)], SCHEMA)
    low, high = ed.split(df, 5)
    assert (low.count(), high.count()) == (6, 4)
    labels = cc.components(low)
    assert {tuple(r) for r in cc.filter_connected(df, labels).collect()} == {(i, i - 10, i) for i in range(6, 10)}


def test_scans_with_ties(spark):
    df = spark.createDataFrame([(1, 2, 3)] * 4 + [(0, 1, 1), (5, 6, 9)], SCHEMA)
    assert sorted(r.scan for r in ed.scan(df, df.w).collect()) == [1, 4, 7, 10, 13, 22]
    assert sorted(r.rank for r in ed.rank(df).collect()) == [1, 2, 3, 4, 5, 6]


def test_edge_file(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("H;10;21;1\nX;1;2;3\n" + "\n".join(f"E;{u};{v};{w}" for u, v, w in parsed(GOLDEN)))
    df = edgelist.read_edges(spark, str(path))
    assert sorted(map(tuple, df.collect())) == sorted(parsed(GOLDEN))
    edgelist.check_header(spark, str(path))
    edgelist.write_edges(df, str(tmp_path / "out"), single=True)
    first = next((tmp_path / "out").glob("part-*")).read_text().split("\n")[0]
    assert first == "H;10;21;1"
    assert edgelist.truth_path("a/b.csv") == "a/b_mst_gt.csv"
    assert edgelist.input_path("root", "g.csv") == "root/input_data/g.csv" and edgelist.input_path("root", "s3://x/g.csv") == "s3://x/g.csv"
    (tmp_path / "bad.csv").write_text("H;1;1;1\nE;a;2;3")
    with pytest.raises(Exception):
        edgelist.read_edges(spark, str(tmp_path / "bad.csv")).collect()


def test_generated_graph_is_connected(spark):
    edges = [tuple(r) for r in weighted_graph(spark, 400, 3, 1, 9, seed=1).collect()]
    assert all(u < v and 1 <= w < 9 for u, v, w in edges) and len(kruskal([(u, v, 1) for u, v, _ in edges])) == 399
    assert sorted(edges) == sorted(map(tuple, weighted_graph(spark, 400, 3, 1, 9, seed=1).repartition(3).collect()))
    older = attached_to(np.arange(60_000), 3, 5)
    degree = np.bincount(older)
    assert (older <= np.arange(60_000) // 3).all() and np.sort(degree)[-20:].sum() > 20 * 20 * 3  # old vertices gather many edges
    assert (attached_to(np.arange(100, 200), 3, 5) == older[100:200]).all()


def test_components_in_rounds_and_at_once(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 - i, 999 - i) for i in range(60)]
    df = spark.createDataFrame(pairs, "u long, v long")
    once, rounds = ({(r.id, r.component) for r in cc.star_forest(df, local_edges=n).collect()} for n in (10**6, 0))
    assert once == rounds and len(once) > 100


def test_forest_of_a_task_that_thins(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 200, 3000), rng.integers(200, 400, 3000), rng.integers(0, 99, 3000))]
    rows = __import__("pandas").DataFrame(edges, columns=["u", "v", "w"])
    monkeypatch.setattr(mst, "HELD_EDGES", 500)
    got = [tuple(map(int, r)) for part in mst._local((rows[i : i + 90] for i in range(0, 3000, 90)), ("u", "v", "w")) for r in part.itertuples(index=False)]
    assert set(got) == kruskal(edges) and len(got) == len(set(got))


def test_bands_beyond_a_task(spark):
    df = spark.createDataFrame(CASES["random"], SCHEMA)
    got = mst.banded(mst.simple_edges(df), 3, local_vertices=1)
    assert {tuple(r) for r in got.select("u", "v", "w").collect()} == kruskal(CASES["random"])


def test_one_value_in_most_rows(spark):
    """Ties are counted or dealt over tasks, never left to one."""
    rng = random.Random(6)
    rows = [(i, i + 1, 5 if rng.random() < 0.8 else rng.randrange(-9, 30)) for i in range(4001)]
    df = spark.createDataFrame([*rows, (0, 0, None)], SCHEMA).repartition(5)
    assert ed.pivot(df).first().pivot == sorted(w for *_, w in rows)[2000]
    assert ed.pivot(df.limit(0)).first().pivot is None
    scanned = ed.scan(df.where("w IS NOT NULL"), df.w, ("w",))
    total, last = 0, None
    for r in sorted(scanned.collect(), key=lambda r: (r.w, r.scan if r.w >= 0 else -r.scan)):
        total += r.w
        assert r.scan == total
    assert ed.scan(df, F.col("w") * 0.5, ("u",)).where("u = 4000").first().scan == pytest.approx(sum(w for *_, w in rows) / 2)
    calls = [("a", i, 1.0 if i % 5 else float(i)) for i in range(1000)] + [("b", 0, 4.0), ("b", 1, None), (None, 0, 2.0), (None, 0, 3.0)]
    got = {r.tag: r for r in stats.timing_stats(spark.createDataFrame(calls, "tag string, call long, seconds double")).collect()}
    a = [s for t, _, s in calls if t == "a"]
    assert (got["a"].median, got["a"].true_median, got["a"].num_calls) == (a[500], sum(sorted(a)[499:501]) / 2, 1000)
    assert (got["b"].median, got["b"].true_median) == (None, 4.0) and (got[None].median, got[None].true_median) == (3.0, 2.5)


def test_light_side_then_filtered_heavy_side(spark):
    """A random pivot splits the edges; the heavy side without what the light side's forest joins, whole part by whole part, makes the forest."""
    for seed in range(3):
        df = spark.createDataFrame(CASES["random"], SCHEMA).where("u <> v")
        low, high = ed.split(df, ed.random_pivot(df, seed).first().pivot)
        light = mst.minimum_spanning_forest(low)
        left = cc.filter_connected(high, cc.components(light))
        parent = {r.id: r.component for r in cc.components(low).collect()}
        want = [tuple(r) for r in high.collect() if parent.get(r.u, r.u) != parent.get(r.v, r.v)]
        assert sorted(map(tuple, left.collect())) == sorted(want)
        assert {tuple(r) for r in mst.minimum_spanning_forest(light.unionByName(left)).collect()} == kruskal(CASES["random"])


def test_memory_of_a_task_does_not_grow_with_the_forest(spark, monkeypatch):
    """Edges that are all in the forest leave the task in pieces; what stays makes the same forest in rounds of joins."""
    rng = np.random.default_rng(9)
    path = [(i, i + 1, int(w)) for i, w in enumerate(rng.integers(0, 9, 3000))]
    dense = [(5000 + int(a), 5100 + int(b), int(w)) for a, b, w in zip(rng.integers(0, 60, 3000), rng.integers(0, 60, 3000), rng.integers(0, 99, 3000))]
    edges = path + list({(u, v): (u, v, w) for u, v, w in dense}.values())
    rows, seen, whole = __import__("pandas").DataFrame(edges, columns=["u", "v", "w"]), [], mst.forest_rows
    monkeypatch.setattr(mst, "HELD_EDGES", 500)
    monkeypatch.setattr(mst, "forest_rows", lambda *c: seen.append(len(c[0])) or whole(*c))
    got = [tuple(map(int, r)) for part in mst._ranges_thinned((rows[i : i + 90] for i in range(0, len(rows), 90)), ("u", "v", "w")) for r in part.itertuples(index=False)]
    assert max(seen) <= 590 and kruskal(edges) <= set(got) and len(got) < len(edges) - 1000 and len(got) == len(set(got))
    monkeypatch.undo()
    monkeypatch.setattr(mst, "RANGE_EDGES", 700)
    monkeypatch.setattr(mst, "LOCAL_VERTICES", 100)
    df = spark.createDataFrame(edges, SCHEMA)
    assert mst._thinned(df, ("u", "v")).count() < df.count() - 1000
    assert {tuple(r) for r in mst.minimum_spanning_forest(df).collect()} == kruskal(edges)
