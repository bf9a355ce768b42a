"""Command line: ``python -m sparkloom forest|histogram|generate --help``."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description="Forests of edge files, histograms of colours and images, generated graphs.")
    commands = top.add_subparsers(dest="command", required=True)
    forest = commands.add_parser("forest", help="time the minimum spanning forest of an edge file and check its weight")
    forest.add_argument("-i", "--input", required=True, help="edge file, or its name in input_data")
    forest.add_argument("-t", "--truth", help="edge file of the known forest (default: the input's name with _mst_gt, if there is such a file); 'none' for no check")
    forest.add_argument("-o", "--output", help="where the timing file goes")
    forest.add_argument("-s", "--strategy", default="auto", choices=("auto", "local", "boruvka", "banded", "adaptive"))
    forest.add_argument("-b", "--bands", type=int, default=8, help="weight bands of the banded strategy")
    forest.add_argument("-r", "--repetitions", type=int, default=1)
    histogram = commands.add_parser("histogram", help="compare the histogram strategies on random colours or on PNG files")
    histogram.add_argument("-i", "--images", help="folder of PNG files; without it, random colours")
    histogram.add_argument("-o", "--output", help="where the runtimes go")
    histogram.add_argument("-r", "--repetitions", type=int, default=10)
    graph = commands.add_parser("generate", help="write preferential-attachment graphs and their forests")
    graph.add_argument("-o", "--output", required=True, help="folder of the edge files")
    graph.add_argument("-n", "--vertices", type=int, nargs="+", required=True)
    graph.add_argument("-m", "--attached", type=int, default=10)
    graph.add_argument("--weights", type=int, nargs=2, default=(0, 100), metavar=("MIN", "MAX"))
    graph.add_argument("--no-truth", action="store_true")
    return top


def main(arguments: list[str] | None = None, spark=None) -> int:
    """0 if all went well, 1 if a forest does not weigh what its truth does."""
    args = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from sparkloom.plans import suites
    from sparkloom.sources import edgelist, results

    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    if args.command == "forest":
        path = edgelist.input_path(".", args.input)
        truth = None if args.truth == "none" else args.truth
        if not args.truth and not edgelist.exists(spark, truth := edgelist.truth_path(path)):
            print(f"no {truth}: the forest's weight is not checked", file=sys.stderr)
            truth = None
        found, ok = suites.run_forest(spark, path, truth, args.output, args.strategy, args.bands, args.repetitions)
        results.print_timings(found)
        return int(ok is False)
    if args.command == "histogram":
        rows = suites.image_suite(spark, args.images, args.output, repetitions=args.repetitions) if args.images else suites.random_suite(spark, args.output, repetitions=args.repetitions)
        rows.groupBy("kernel", "input").avg("runtime").orderBy("input", "kernel").show(1000, truncate=False)
        return 0
    low, high = args.weights
    graphs = [{"name": f"graph_{n}_{args.attached}", "n": n, "m": args.attached, "w_min": low, "w_max": high} for n in args.vertices]
    suites.create_graphs(spark, graphs, args.output, not args.no_truth)
    return 0


if __name__ == "__main__":
    sys.exit(main())
