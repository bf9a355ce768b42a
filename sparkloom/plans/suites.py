"""Benchmark suites: histograms of random colours and images, graph batches and forest runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions import generate
from sparkloom.operators import histogram as hist
from sparkloom.operators import mst, stats
from sparkloom.sources import edgelist, png, results
from sparkloom.staging import Stage

from .runner import Stopwatch, compare_kernels

KERNELS = {"grouped": hist.histogram, "conditional": hist.conditional_histogram}
#: Pixels and numbers of colours of the random suite.
SIZES = (640 * 426, 3840 * 2160)
COLOR_COUNTS = (1, 2, 5, 256)


def _runtimes(spark: SparkSession, watch: Stopwatch, name: str) -> DataFrame:
    return watch.frame(spark).selectExpr("tag AS kernel", f"'{name}' AS input", "seconds AS runtime")


def random_suite(spark: SparkSession, out: str | None = None, sizes: Iterable[int] = SIZES, color_counts: Iterable[int] = COLOR_COUNTS, repetitions: int = 10) -> DataFrame:
    """(kernel, input, runtime) of every kernel over random colours, each result held against another kernel's."""
    stage, all_ = Stage(spark, "colors"), None
    for size in sizes:
        for k in color_counts:
            colors = stage.write(generate.random_colors(spark, size, k), f"{size}-{k}")
            rows = _runtimes(spark, compare_kernels(KERNELS, colors, hist.histogram(colors), repetitions), f"random_{k}_{size}")
            all_ = rows if all_ is None else all_.unionByName(rows)
    if out:
        results.append_runtimes(all_, out, first=True)
    return all_


def image_suite(spark: SparkSession, images: str, out: str | None = None, modes: Iterable[str] = ("grayscale", "rgb", "rgba"), repetitions: int = 10) -> DataFrame:
    """The same over every PNG file under ``images``, by colour mode; decoding is not timed."""
    stage, all_ = Stage(spark, "images"), None
    pixels = stage.write(png.read_pixels(spark, images), "pixels")
    for i, name in enumerate(r["image"] for r in pixels.select("image").distinct().orderBy("image").collect()):  # one row a file
        for mode in modes:
            colors = stage.write(png.colors(pixels.where(pixels["image"] == name), mode).select("color"), f"{mode}-{i}")
            rows = _runtimes(spark, compare_kernels(KERNELS, colors, hist.histogram(colors), repetitions), f"{name.rsplit('/', 1)[-1]}_{mode}")
            all_ = rows if all_ is None else all_.unionByName(rows)
    if out and all_ is not None:
        results.append_runtimes(all_, out, first=True)
    return all_ if all_ is not None else spark.createDataFrame([], results.RUNTIMES)


def create_graphs(spark: SparkSession, graphs: Iterable[dict], folder: str, with_truth: bool = True, seed: int = 0) -> list[str]:
    """Write each graph {name, n, m, w_min, w_max} as an edge file, and its forest's beside it."""
    paths = []
    for g in graphs:
        rows = Stage(spark, "graph").write(generate.weighted_graph(spark, g["n"], g["m"], g.get("w_min", 0), g.get("w_max", 100), seed), "edges")
        path = f"{folder.rstrip('/')}/{g['name']}.csv"
        edgelist.write_edges(rows, path)
        if with_truth:
            edgelist.write_edges(mst.minimum_spanning_forest(rows), edgelist.truth_path(path))
        paths.append(path)
    return paths


def run_forest(spark: SparkSession, path: str, truth: str | None = None, out: str | None = None, strategy: str = "auto", bands: int = 8, repetitions: int = 1) -> tuple[DataFrame, bool | None]:
    """Time the forest of an edge file; (timing statistics, whether it weighs what the truth does, None without one).

    A file, or a truth, whose header doesn't have the number of its edges stops the run.
    """
    watch, ok, stage = Stopwatch(), None, Stage(spark, "run")
    for file in filter(None, (path, truth)):
        edgelist.check_header(spark, file)
    with watch.timed("read"):
        edges = stage.write(edgelist.read_edges(spark, path), "edges")
    for i in range(repetitions):
        with watch.timed(f"forest_{strategy}"):
            tree = stage.write(mst.minimum_spanning_forest(edges, strategy, bands), f"tree{i}")
    if truth:
        ok = bool(mst.check_solution(tree, edgelist.read_edges(spark, truth)).first()["ok"])
    found = stats.timing_stats(watch.frame(spark))
    if out:
        results.write_timings(found, out)
    return found, ok


def run_benchmark(spark: SparkSession, runs: Iterable[dict], inputs: str, outputs: str) -> list[tuple[str, bool | None]]:
    """Every run of ``runner.run_list`` with its flags; one that fails its check is reported, the others go on."""
    done = []
    for run in runs:
        path = f"{inputs.rstrip('/')}/{run['name']}.csv"
        _, ok = run_forest(spark, path, edgelist.truth_path(path), edgelist.output_path(outputs, run["name"]), repetitions=run["repetitions"], **run["flags"])
        done.append((run["name"], ok))
    return done
