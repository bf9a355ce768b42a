"""Timing of named steps and the kernel comparison runner."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.histogram import verify


class Stopwatch:
    """Collects (tag, call, seconds)."""

    def __init__(self) -> None:
        self.calls: dict[str, list[float]] = defaultdict(list)

    @contextmanager
    def timed(self, tag: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.calls[tag].append(time.perf_counter() - began)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(tag, i, s) for tag, all_ in self.calls.items() for i, s in enumerate(all_)]
        return spark.createDataFrame(rows, "tag string, call long, seconds double")


def compare_kernels(kernels: dict[str, Callable[[DataFrame], DataFrame]], colors: DataFrame, truth: DataFrame, repetitions: int = 10) -> Stopwatch:
    """Run every kernel ``repetitions`` times and hold its result against ``truth``; a wrong one stops the run."""
    watch = Stopwatch()
    for name, kernel in kernels.items():
        for _ in range(repetitions):
            with watch.timed(name):
                kernel(colors).write.format("noop").mode("overwrite").save()
        verify(kernel(colors), truth)
    return watch


def run_list(sizes: Iterable[int], density: str, prefix: str, flags: dict, repetitions: int = 10, repetitions_last: int = 3) -> list[dict]:
    """One entry a size; the largest, which comes last, is run fewer times."""
    sizes = list(sizes)
    return [{"n": n, "name": f"{prefix}_{n}_{density}", "flags": flags, "repetitions": repetitions_last if i == len(sizes) - 1 else repetitions} for i, n in enumerate(sizes)]
