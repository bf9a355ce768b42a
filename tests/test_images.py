"""Colour models, palettes, scanline filters, interlacing, prefix codes and checksums against plain loops."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import coding, colour, scanlines
from sparkloom.sources import png

PIXELS = "image string, pos long, r int, g int, b int, a int, extra string"


def images():
    rng = random.Random(4)
    grey = lambda v: (v, v, v, 255)
    out = {
        "one": [grey(7)], "black-white": [grey(rng.choice((0, 255))) for _ in range(40)], "grey2": [grey(85 * rng.randrange(4)) for _ in range(40)],
        "grey4": [grey(17 * rng.randrange(16)) for _ in range(60)], "grey8": [grey(rng.randrange(256)) for _ in range(900)],
        "grey-key": [(0, 0, 0, 0) if i % 5 == 0 else grey(17 * (1 + i % 15)) for i in range(60)], "key-clash": [(0, 0, 0, 0 if i else 255) for i in range(60)],
        "two-keys": [(i % 2, 0, 0, 0) for i in range(60)], "few-key": [(0, 0, 0, 0), *[grey(255)] * 9], "partly": [(9, 9, 9, i % 3) for i in range(700)],
        "palette": [(i % 200, 5, 5, 255) for i in range(900)], "exactly-256": [(i % 256, i % 256, 3, 255) for i in range(700)], "exactly-257": [(i % 257 % 256, i % 257 // 256, 3, 255) for i in range(700)],
        "many": [(i % 256, i // 256, 3, 255) for i in range(3000)], "many-key": [(i % 256, i // 256, 3, 0 if i == 0 else 255) for i in range(3000)], "small": [(i, 5, 5, 255) for i in range(9)],
    }
    return out


def plain_model(pixels):
    """Kind, depth and key, found the long way."""
    colored = any(r != g or r != b for r, g, b, _ in pixels)
    clear = {p[:3] for p in pixels if p[3] == 0}
    alpha = any(0 < p[3] < 255 for p in pixels) or len(clear) > 1 or any(p[:3] in clear for p in pixels if p[3])
    key = min(clear) if clear and not alpha else None
    depth = 8 if colored or alpha else max(next(d for d, levels in ((1, (0, 255)), (2, range(0, 256, 85)), (4, range(0, 256, 17)), (8, range(256))) if p[0] in levels) for p in pixels)
    n = len(set(pixels))
    if key and len(pixels) <= 16 or key == (0, 0, 0) and len(pixels) <= 16:
        alpha, key, depth = True, None, 8
    bits = next(b for b in (1, 2, 4, 8) if n <= 1 << b) if n <= 256 else None
    if bits and len(pixels) >= 2 * n and not (not colored and not alpha and depth <= bits):
        return 3, bits, None
    kind = {(True, True): 6, (True, False): 2, (False, True): 4, (False, False): 0}[colored, alpha]
    return kind, depth, key and tuple(k // (255 // ((1 << depth) - 1)) for k in key)


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(name, i, *p, "x") for name, all_ in images().items() for i, p in enumerate(all_)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, PIXELS).repartition(7)


def test_colour_model(pixels, monkeypatch):
    monkeypatch.setattr(colour, "IMAGES_HELD", 3)
    got = {r.image: r for r in colour.choose_model(colour.colour_stats(pixels)).collect()}
    for name, all_ in images().items():
        kind, depth, key = plain_model(all_)
        r = got[name]
        assert (r.color_type, r.bit_depth, r.n_colors, r.n_pixels) == (kind, depth, min(257, len(set(all_))), len(all_)), name
        assert (None if r.key_r is None else (r.key_r, r.key_g, r.key_b)) == key, name


def test_colour_model_edges(spark, pixels):
    assert colour.choose_model(colour.colour_stats(pixels.limit(0))).count() == 0 and colour.palettes(pixels.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 0, None, 0, 0, 255, ""), (None, 1, 0, 0, 0, 255, "")], PIXELS)
    r = colour.colour_stats(odd).first()
    assert r.image is None and (r.n_pixels, r.colored, r.bits, r.n_colors) == (2, False, 1, 1)
    deep = [("deep", i, 300, 300, 300, 65535, "") for i in range(20)] + [("flat", i, 257 * 7, 257 * 7, 257 * 7, 0 if i else 65535, "") for i in range(20)]
    deep += [("deep-key", i, 300 * (i > 9), 0, 0, 65535 * (i > 9), "") for i in range(20)]
    got = {r.image: r for r in colour.choose_model(colour.colour_stats(spark.createDataFrame(deep, PIXELS), bits=16), bits=16).collect()}
    assert (got["deep"].bits, got["deep"].color_type, got["deep"].bit_depth, got["deep"].n_colors) == (16, 0, 16, 0)
    assert (got["flat"].bits, got["flat"].alpha, got["flat"].n_colors) == (8, True, 2)
    assert (got["deep-key"].color_type, got["deep-key"].bit_depth, got["deep-key"].key_r) == (2, 16, 0)


def test_palette_and_packing(spark, pixels):
    palette = colour.palettes(pixels)
    rows = {}
    for r in palette.collect():
        rows.setdefault(r.image, {})[r.idx] = (r.r, r.g, r.b, r.a)
    want = {n: list(dict.fromkeys(p)) for n, p in images().items()}
    assert {n: [v[i] for i in range(len(v))] for n, v in rows.items()} == {n: v for n, v in want.items() if len(v) <= 256}
    indices = colour.indexed(pixels, palette).join(colour.index_bits(palette), "image")
    for width in (1, 7, 16):
        packed = colour.packed_rows(indices, width)
        back = colour.unpacked_rows(packed.join(colour.index_bits(palette), "image"), width).join(palette, ["image", "idx"])
        got = {(r.image, r.pos): (r.r, r.g, r.b, r.a) for r in back.collect()}
        assert all(got[n, i] == p for n, all_ in images().items() if n in rows for i, p in enumerate(all_))


def lines(rng, height, width, step):
    smooth = np.cumsum(rng.integers(-3, 4, (height, width * step)), axis=1) % 256
    noise = rng.integers(0, 256, (height, width * step))
    return np.where(np.arange(height)[:, None] % 4 == 3, noise, smooth).astype(np.uint8)


def plain_filters(image, step, strategy):
    out, above = [], np.zeros(image.shape[1], int)
    for row in image.astype(int):
        left, corner = np.concatenate([np.zeros(step, int), row[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        base = left + above - corner
        paeth = np.array([min((a, b, c), key=lambda v, p=p: abs(p - v)) for a, b, c, p in zip(left, above, corner, base)])
        tries = [(row - g) % 256 for g in (0 * row, left, above, (left + above) // 2, paeth)]
        if strategy == "minsum":
            scores = [sum(int(v) if k == 0 or v < 128 else 255 - int(v) for v in t) for k, t in enumerate(tries)]
        else:
            scores = []
            for k, t in enumerate(tries):
                counts = np.bincount([*t, k], minlength=256)
                power = lambda n: int(n).bit_length() - 1
                scores.append(-sum(int(n) * power(n) + 2 * (int(n) - (1 << power(n))) for n in counts if n))
        k = scores.index(min(scores))
        out.append((k, tries[k]))
        above = row
    return out


@pytest.mark.parametrize("strategy", ["minsum", "entropy"])
def test_filters(spark, monkeypatch, strategy):
    monkeypatch.setattr(scanlines, "BAND", 4)
    rng = np.random.default_rng(2)
    shapes = {"a": (11, 9, 3), "b": (4, 6, 3), "c": (1, 1, 3), "d": (9, 17, 3)}
    made = {n: lines(rng, h, w, s) for n, (h, w, s) in shapes.items()}
    rows = spark.createDataFrame([(n, y, line.tolist()) for n, image in made.items() for y, line in enumerate(image)], "image string, y long, line array<int>").repartition(3)
    chosen = scanlines.choose_filters(rows, 3, strategy)
    got = {(r.image, r.y): r.filter for r in chosen.collect()}
    done = {(r.image, r.y): (r.filter, r.line) for r in scanlines.filtered_rows(rows, chosen, 3).collect()}
    for n, image in made.items():
        want = plain_filters(image, 3, strategy)
        assert [got[n, y] for y in range(len(image))] == [k for k, _ in want]
        raw = b"".join(bytes([done[n, y][0], *done[n, y][1]]) for y in range(len(image)))
        assert (png._unfilter(raw, 0, *image.shape, 3)[0] == image).all()
    assert len({k for k in got.values()}) > 2
    with pytest.raises(ValueError):
        scanlines.choose_filters(rows, 3, "best")


def test_interlacing_of_every_size(spark):
    sizes = spark.range(1, 21).select(F.col("id").alias("width")).crossJoin(spark.range(1, 21).select(F.col("id").alias("height")))
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), (F.col("width") * F.col("height") - 1).cast("int"))).alias("i")).selectExpr("*", "i % width AS x", "i div width AS y")
    back = scanlines.interlaced_pixel(F.col("place"), F.col("width"), F.col("height"))
    rows = scanlines.interlace(grid).withColumn("back", back).collect()
    places = {}
    for r in rows:
        assert (r.back.x, r.back.y) == (r.x, r.y)
        places.setdefault((r.width, r.height), {})[r.place] = (r.x, r.y)
    for (w, h), got in places.items():
        want = [(x, y) for x0, y0, dx, dy in png.PASSES for y in range(y0, h, dy) for x in range(x0, w, dx)]
        assert [got[i] for i in range(w * h)] == want


def best_cost(counts, most):
    used = sorted((c for c in counts if c), reverse=True)
    return min((sum(c * n for c, n in zip(used, lengths)) for lengths in itertools.combinations_with_replacement(range(1, most + 1), len(used)) if sum(2.0**-n for n in lengths) <= 1), default=None)


def test_limited_lengths():
    rng = random.Random(3)
    for most in (3, 4, 5):
        for _ in range(60):
            counts = [rng.choice((0, 1, 1, 2, 5, 40, 900)) for _ in range(rng.randrange(2, 8))]
            if sum(c > 0 for c in counts) < 2:
                continue
            got = coding.limited_lengths(counts, most)
            assert max(got) <= most and all((n > 0) == (c > 0) for n, c in zip(got, counts))
            assert sum(2.0**-n for n in got if n) == 1 and sum(c * n for c, n in zip(counts, got)) == best_cost(counts, most)
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    got = coding.limited_lengths(fibonacci)
    assert max(got) == 15 and sum(2.0**-n for n in got) == 1
    assert coding.limited_lengths([0, 0, 0]) == [1, 1, 0] and coding.limited_lengths([0, 0, 9]) == [0, 1, 1]
    with pytest.raises(ValueError):
        coding.limited_lengths([1] * 9, 3)


def test_code_lengths_by_group(spark):
    rows = [("a", s, s * s) for s in range(40)] + [("b", 3, 5), ("b", 700, 1), ("b", 4, None)] + [(None, s, 1) for s in range(5)]
    codes = coding.code_lengths(spark.createDataFrame(rows, "k string, bucket int, n long").repartition(3), ("k",), 256).collect()
    by = {}
    for r in codes:
        by.setdefault(r.k, []).append((f"{r.code:0{r.length}b}", r.symbol))
    assert set(by) == {"a", "b", None} and {s for _, s in by["a"]} == set(range(1, 40)) and len(by["b"]) == 2
    for found in by.values():
        words = sorted(w for w, _ in found)
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert coding.code_lengths(spark.createDataFrame([], "k string, bucket int, n long"), ("k",), 256).count() == 0


def test_checksums(spark):
    rng = random.Random(8)
    data = {i: rng.randbytes(n) for i, n in enumerate((0, 1, 300, 70_000, 1_000_000))} | {None: b"\xff" * 100_000}
    rows = []
    for k, whole in data.items():
        at = seq = 0
        while at < len(whole) or not seq:
            n = rng.choice((0, 1, 7, 4000, 50_000))
            rows.append((k, seq, whole[at : at + n] or (None if rng.random() < 0.5 else b""), "x"))
            at, seq = at + n, seq + 1
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "stream long, seq int, block binary, size string").repartition(5)
    got = {r.stream: (r.n_bytes, r.crc32, r.adler32) for r in coding.stream_checksums(blocks).collect()}
    assert got == {k: (len(v), zlib.crc32(v), zlib.adler32(v)) for k, v in data.items()}
    assert coding.stream_checksums(blocks.limit(0)).count() == 0


@pytest.mark.parametrize("strategy", ["minsum", "entropy"])
def test_filters_are_chosen_in_one_shuffle(spark, strategy):
    """The bytes of a row are counted in the row: only whole rows are dealt, for the row above."""
    rows = spark.createDataFrame([("a", y, [y % 5] * 48) for y in range(40)] + [("none", 0, [])], "image string, y long, line array<int>")
    chosen = scanlines.choose_filters(rows, 3, strategy)
    assert chosen._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert chosen.where("image = 'a'").count() == 40 and chosen.where("image = 'none'").count() == 0


def test_least_colours_hold_no_batch():
    """Of a batch with many colours only the least stay in memory."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    n, images = 10_000, 300
    frame = SimpleNamespace(dtypes=[("image", "bigint")], mapInArrow=lambda run, schema: run)
    batches = (pa.record_batch({"image": np.full(n, i), "code": np.arange(n)[::-1], "pos": np.arange(n)}) for i in range(images))
    tracemalloc.start()
    try:
        (out,) = colour._least_colours(frame)(batches)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == images * colour.MANY and out.column("code").to_pylist()[: colour.MANY] == list(range(colour.MANY))
    assert peak < 20e6, peak  # with whole batches' colours held: 50 MB
