import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.generate import random_colors, round_robin_colors
from sparkloom.functions.scalars import luma
from sparkloom.operators import histogram as hist
from sparkloom.operators import stats
from sparkloom.plans.runner import compare_kernels, run_list
from sparkloom.sources import edgelist, file_sources, png, results
from sparkloom.streaming.running import running_histogram, windowed_timings


def test_timing_statistics(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, 5.0)], "tag string, call long, seconds double")
    got = {r.tag: r for r in stats.timing_stats(rows).collect()}
    a = got["a"]
    assert (a.average, a.median, a.total, a.num_calls, a.true_median) == (2.0, 1.0, 6.0, 3, 2.0)
    assert a.std_dev == pytest.approx(2**0.5 / 3) and a.std_pop == pytest.approx((2 / 3) ** 0.5)
    results.write_timings(stats.timing_stats(rows), str(tmp_path / "t"))
    assert [r.tag for r in results.read_timings(spark, str(tmp_path / "t")).collect()] == ["a", "b"]
    results.print_timings(stats.timing_stats(rows))
    assert {r.tag: r.median for r in stats.upper_median(rows).collect()} == {"a": 2.0, "b": 5.0}


def test_kernels_agree_and_wrong_ones_stop(spark, tmp_path):
    colors = random_colors(spark, 5_000, 5)
    truth = hist.histogram(colors)
    watch = compare_kernels({"grouped": hist.histogram, "conditional": hist.conditional_histogram}, colors, truth, repetitions=1)
    assert watch.frame(spark).count() == 2
    with pytest.raises(AssertionError):
        compare_kernels({"bad": lambda c: hist.histogram(c.where("color <> 1"))}, colors, truth, repetitions=1)
    rows = spark.createDataFrame([("k", "i", 0.5)], results.RUNTIMES)
    results.append_runtimes(rows, str(tmp_path / "r"), first=True)
    results.append_runtimes(rows, str(tmp_path / "r"))
    assert results.read_runtimes(spark, str(tmp_path / "r")).count() == 2
    assert [r["repetitions"] for r in run_list([1, 2, 3], "10", "p", {})] == [10, 10, 3]


def test_empty_histogram(spark):
    got = hist.histogram(round_robin_colors(spark, 0)).agg(F.count("*"), F.sum("n")).first()
    assert tuple(got) == (256, 0)


def test_luma_truncates(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("g")).withColumn("y", luma("g", "g", "g")).collect()
    assert [r.g for r in rows if r.y != r.g][:5] == [1, 2, 4, 8, 11] and sum(r.y != r.g for r in rows) == 65


def test_streams(spark, tmp_path):
    round_robin_colors(spark, 1_000, 7).repartition(3).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("pos long, color int").parquet(str(tmp_path / "c"))
    q = running_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    assert {r.bucket: r.n for r in spark.table("hist").collect()} == {i: 142 + (i < 6) for i in range(7)}
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, 'a' AS tag, cast(id AS double) AS seconds FROM range(120)")
    rows.write.parquet(str(tmp_path / "t"))
    timed = windowed_timings(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t")), "ts", "1 hour", "10 minutes")
    q = timed.writeStream.outputMode("update").format("memory").queryName("timed").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.num_calls for r in spark.table("timed").collect()) == 120


def test_command_line(spark, tmp_path, capsys):
    from sparkloom.__main__ import main

    assert main(["generate", "-o", str(tmp_path / "g"), "-n", "60", "-m", "3", "--weights", "1", "9"], spark) == 0
    path = str(tmp_path / "g" / "graph_60_3.csv")
    assert main(["forest", "-i", path, "-o", str(tmp_path / "t"), "-s", "local", "-r", "2"], spark) == 0
    assert {r.tag: r.num_calls for r in results.read_timings(spark, str(tmp_path / "t")).collect()} == {"read": 1, "forest_local": 2}
    assert main(["forest", "-i", path, "-t", path], spark) == 1
    assert "forest_auto" in capsys.readouterr().out
    with pytest.raises(SystemExit) as stopped:
        main(["--help"], spark)
    assert stopped.value.code == 0


def test_suites(spark, tmp_path):
    import numpy as np

    from sparkloom.plans import suites
    from sparkloom.sources.png import encode_rgba

    rows = suites.random_suite(spark, str(tmp_path / "r"), sizes=(500,), color_counts=(1, 5), repetitions=1)
    assert rows.count() == results.read_runtimes(spark, str(tmp_path / "r")).count() == 4
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(encode_rgba(np.arange(6 * 5 * 4, dtype=np.uint8).reshape(6, 5, 4)))
    found = suites.image_suite(spark, str(tmp_path / "i"), repetitions=1)
    assert {r.input for r in found.collect()} == {"a.png_grayscale", "a.png_rgb", "a.png_rgba"}
    suites.create_graphs(spark, [{"name": "p_30_3", "n": 30, "m": 3}, {"name": "p_40_3", "n": 40, "m": 3}], str(tmp_path / "in"))
    runs = run_list([30, 40], "3", "p", {"strategy": "local"}, repetitions=1, repetitions_last=1)
    assert suites.run_benchmark(spark, runs, str(tmp_path / "in"), str(tmp_path)) == [("p_30_3", True), ("p_40_3", True)]


def test_sorted_reader_and_projection(spark, tmp_path):
    from sparkloom.functions.scalars import seconds
    from sparkloom.sources import edgelist

    graph = spark.createDataFrame([(5, 6, 1), (1, 9, 2), (1, 2, 3)], "source long, target long, weight long")
    rows = edgelist.edge_projection(graph)
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 3), (1, 9, 2), (5, 6, 1)]
    edgelist.write_edges(rows.repartition(3), str(tmp_path / "e"))
    assert [tuple(r) for r in edgelist.sorted_graph(spark, str(tmp_path / "e")).collect()] == [(1, 2, 3), (1, 9, 2), (5, 6, 1)]
    edgelist.check_header(spark, str(tmp_path / "e"))
    assert spark.range(1).withColumn("x", F.lit(1_500_000_000)).select(seconds("x")).first()[0] == 1.5


def test_pivot_of_ranks(spark):
    from sparkloom.operators import edges as ed

    for weights in ([4], [3, 1], [5, 5, 1, 2], [7, None, 1, 3], []):
        known = sorted(w for w in weights if w is not None)
        df = spark.createDataFrame([(0, 1, w) for w in weights], "u long, v long, w long")
        assert ed.pivot(df).first().pivot == (known[(len(known) + 1) // 2 - 1] if known else None)


def test_histogram_groups_and_strange_values(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 3), ("b", 999), (None, 5), ("b", None), ("a", -1)], "g string, color int")
    got = {(r.g, r.bucket): r.n for r in hist.histogram(rows, by=("g",), buckets=40).collect()}
    assert len(got) == 3 * 40 and sum(got.values()) == 3 and got["a", 3] == 2 and got[None, 5] == 1
    assert {(r.bucket, r.n) for r in hist.conditional_histogram(rows, buckets=40).collect()} == {(r.bucket, r.n) for r in hist.histogram(rows, buckets=40).collect()}


EDGES = "u long, v long, w long"


def test_edge_source(spark, tmp_path):
    path = str(tmp_path / "edges")
    rows = [(i, i * 7 % 5000 + 10_000, i % 13 - 5) for i in range(5000)]
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    header = file_sources.write_edge_files(df, path).collect()
    assert [tuple(r) for r in header] == [(10_000, 5000, 1)]
    edgelist.check_header(spark, path)
    assert sorted(map(tuple, edgelist.read_edges(spark, path).collect())) == sorted(rows)
    for split in (97, 1000, 10**9):
        read = spark.read.format("edge_file").option("split", split).load(f"file://{path}")
        assert sorted(map(tuple, read.collect())) == sorted(rows), split
    (tmp_path / "one.csv").write_text("H;2;1;1\nX;1;1;1\n\nE;1;2;3")
    assert [tuple(r) for r in spark.read.format("edge_file").load(str(tmp_path / "one.csv")).collect()] == [(1, 2, 3)]
    (tmp_path / "bad.csv").write_text("E;1;x;3\n")
    with pytest.raises(Exception):
        spark.read.format("edge_file").load(str(tmp_path / "bad.csv")).collect()
    before = sorted(p.name for p in (tmp_path / "edges").iterdir())
    with pytest.raises(Exception):  # a write that fails leaves all as it was
        df.withColumn("w", F.when(F.col("u") < 4990, F.col("w"))).write.format("edge_file").option("nodes", 1).mode("overwrite").save(path)
    with pytest.raises(Exception, match="already"):
        df.write.format("edge_file").option("nodes", 1).mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "edges").iterdir()) == before
    assert [tuple(r) for r in file_sources.write_edge_files(df.limit(0), path).collect()] == [(0, 0, 1)] and len(list((tmp_path / "edges").glob("*.csv"))) == 1


def test_edge_source_counts_each_task_once(tmp_path):
    """A task that is run again has written two parts; one of them is told to the commit, and the other goes."""
    writer = file_sources.EdgeWriter(str(tmp_path / "edges"), "4", True)
    batch = pa.RecordBatch.from_pydict({"u": [1, 2], "v": [3, 4], "w": [5, 6]})
    writer.write(iter([batch]))
    again, empty = writer.write(iter([batch])), writer.write(iter([]))
    writer.commit([again, None, empty])
    found = {p.name: p.read_text() for p in (tmp_path / "edges").iterdir()}
    assert found == {"head.csv": "H;4;2;1\n", again.name: "E;1;3;5\nE;2;4;6\n"}


def test_chunk_source(spark, tmp_path):
    image = np.zeros((3, 2, 4), np.uint8)
    for i in range(3):
        (tmp_path / f"{i}.png").write_bytes(png.encode_rgba(image))
    (tmp_path / "cut.png").write_bytes(png.encode_rgba(image)[:-5])
    file_sources.register(spark)
    want = {(r.image.rsplit("/", 1)[1], *r[1:]) for r in png.chunk_table(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    read = {(r.image.rsplit("/", 1)[1], *r[1:]) for r in spark.read.format("png_chunks").load(str(tmp_path)).collect()}
    assert read == want and len(want) == 12
    quick = spark.read.format("png_chunks").option("check", "false").load(f"file://{tmp_path}").collect()
    assert len(quick) == 12 and all(r.crc_ok is None for r in quick)
