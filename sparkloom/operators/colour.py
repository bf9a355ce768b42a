"""Colour statistics of images, the cheapest PNG colour model, palettes and indices.

Pixels are rows (image, pos, r, g, b, a). All results are aggregates whose partial states
have a fixed bound, so an image may lie across any number of tasks:

* what only grows (coloured, partly transparent, grey depth) is a maximum,
* distinct colours are counted up to ``MANY``: a task keeps the ``MANY`` least colours of
  an image, and the least of the union of such sets are those of the whole,
* the colour key is the one colour of all transparent pixels. Whether a visible pixel has
  it too is asked afterwards, of images with such a colour alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One more colour than a palette can hold; images with more are counted as this.
MANY = 257
#: Images whose colours a task holds at once; beyond it they are handed on and counted anew.
IMAGES_HELD = 1024
#: Colour types of the format.
GREY, RGB, PALETTE, GREY_ALPHA, RGBA = 0, 2, 3, 4, 6
#: Fewer pixels don't pay for a colour key.
KEY_PIXELS = 16


def colour_code(bits: int = 8) -> Column:
    """A pixel's channels as one integer of 4 x 8 or, reduced to their high bytes, 4 x 16 bits."""
    code = F.lit(0).cast("long")
    for c in ("r", "g", "b", "a"):
        code = code * 256 + (F.col(c) if bits == 8 else F.shiftright(F.col(c), 8))
    return code


def grey_bits(value: Column) -> Column:
    """Bits that a grey level of 8 bits needs: levels of 1, 2 and 4 bits are multiples of 255, 85 and 17."""
    return F.when(value.isin(0, 255), 1).when(value % 85 == 0, 2).when(value % 17 == 0, 4).otherwise(8)


def _least_colours(pixels: DataFrame) -> DataFrame:
    """(image, code, pos): in each task the ``MANY`` least colours of its images and where each stood first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            images = batch.column("image").dictionary_encode()
            order = np.argsort(images.indices.fill_null(-1).to_numpy(), kind="stable")
            number = images.indices.fill_null(-1).to_numpy()[order]
            code, pos = batch.column("code").to_numpy()[order], batch.column("pos").to_numpy()[order]
            cuts = np.flatnonzero(np.diff(number)) + 1
            for c, p, i in zip(np.split(code, cuts), np.split(pos, cuts), number[np.append(0, cuts)] if len(number) else ()):
                name = images.dictionary[int(i)].as_py() if i >= 0 else None
                old = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                c, p = np.concatenate([old[0], c]), np.concatenate([old[1], p])
                by = np.lexsort((p, c))
                c, p = c[by], p[by]
                first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))[:MANY]
                held[name] = c[first], p[first]  # no views of the batch's colours
            if len(held) > IMAGES_HELD:
                yield made(held, batch.schema.field("image").type)
                held = {}
        if held:
            yield made(held, batch.schema.field("image").type)

    def made(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        n = [len(c) for c, _ in held.values()]
        names = pa.array(list(held), kind).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate([v[j] for v in held.values()])) for j in (0, 1))], names=["image", "code", "pos"])

    kind = dict(pixels.dtypes)["image"]
    return pixels.mapInArrow(run, f"image {kind}, code long, pos long")


def distinct_colours(pixels: DataFrame, bits: int = 8) -> DataFrame:
    """(image, code, pos): up to ``MANY`` distinct colours of each image and where each stands first."""
    rows = pixels.select("image", colour_code(bits).alias("code"), F.col("pos").cast("long").alias("pos"))
    merged = _least_colours(rows).groupBy("image", "code").agg(F.min("pos").alias("pos"))
    least = F.row_number().over(Window.partitionBy("image").orderBy("code"))  # the window's limit is applied before its shuffle too
    return merged.withColumn("_n", least).where(F.col("_n") <= MANY).drop("_n")


def colour_stats(pixels: DataFrame, bits: int = 8) -> DataFrame:
    """(image, n_pixels, colored, alpha, key, bits, n_colors), one row an image.

    key is the code of the colour (r * 256 + g) * 256 + b, in samples of ``bits`` bits, that
    stands for transparent; null where none is needed or one isn't enough, in which case
    alpha is true. bits is 1, 2, 4 or 8 for grey levels, 8 for anything else, and 16 where a
    16-bit sample's bytes differ; n_colors is then 0. Null channels count as 0, a null image is an image.
    """
    size = 256 if bits == 8 else 65536
    whole = pixels.select("image", "pos", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("r", "g", "b", "a")))
    r, g, b, a = (F.col(c) for c in ("r", "g", "b", "a"))
    rgb = (r * size + g) * size + b
    deep = F.lit(False)
    if bits == 16:
        for c in (r, g, b, a):
            deep = deep | (F.shiftright(c, 8) != c % 256)
    sums = whole.groupBy("image").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.max((r != g) | (r != b)).alias("colored"), F.max((a > 0) & (a < size - 1)).alias("partly"),
        F.min(F.when(a == 0, rgb)).alias("low"), F.max(F.when(a == 0, rgb)).alias("high"),
        F.max(grey_bits(r if bits == 8 else F.shiftright(r, 8))).alias("grey"), F.max(deep).alias("deep"),
    )
    asked = sums.where("NOT partly AND low = high").select(F.col("image").alias("_image"), F.col("low").alias("_key"))
    seen = whole.where(a > 0).join(asked, F.col("_image").eqNullSafe(F.col("image")) & (rgb == F.col("_key")), "left_semi").select("image").distinct().select(F.col("image").alias("_seen"), F.lit(True).alias("clash"))
    n_colors = distinct_colours(whole, bits).groupBy(F.col("image").alias("_counted")).agg(F.count(F.lit(1)).alias("n"))
    joined = sums.join(seen, F.col("_seen").eqNullSafe(F.col("image")), "left").join(n_colors, F.col("_counted").eqNullSafe(F.col("image")))
    alpha = F.col("partly") | F.coalesce(F.col("low") != F.col("high"), F.lit(False)) | F.coalesce("clash", F.lit(False))
    depth = F.when(F.col("deep"), 16).when(F.col("colored") | alpha, 8).otherwise(F.col("grey"))
    return joined.select("image", "n_pixels", "colored", alpha.alias("alpha"), F.when(~alpha, F.col("low")).alias("key"), depth.cast("int").alias("bits"), F.when(F.col("deep"), 0).otherwise(F.col("n")).cast("long").alias("n_colors"))


def choose_model(stats: DataFrame, bits: int = 8) -> DataFrame:
    """``stats`` with color_type, bit_depth, key_r, key_g and key_b: the model with the fewest bits that holds every pixel.

    A palette needs two pixels a colour at least, and gives way to grey of as few bits; a
    colour key takes the place of an alpha channel beyond ``KEY_PIXELS`` pixels. The key is
    in samples of the model's depth; ``bits`` is the depth of the samples that were counted.
    """
    size = bits
    n = F.col("n_colors")
    few = F.col("key").isNotNull() & (F.col("n_pixels") <= KEY_PIXELS)
    alpha, grey = F.col("alpha") | few, ~F.col("colored")
    bits = F.when((few | ~grey) & (F.col("bits") < 8), 8).otherwise(F.col("bits"))
    index = F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8)
    palette = n.between(1, MANY - 1) & (bits <= 8) & (F.col("n_pixels") >= 2 * n) & ~(grey & ~alpha & (bits <= index))
    kind = F.when(palette, PALETTE).when(alpha, F.when(grey, GREY_ALPHA).otherwise(RGBA)).otherwise(F.when(grey, GREY).otherwise(RGB))
    key = F.when(~palette & ~few, F.col("key"))
    mask = F.expr("shiftleft(1L, bit_depth) - 1")
    chosen = stats.withColumns({"color_type": kind, "bit_depth": F.when(palette, index).otherwise(bits).cast("int"), "_key": key})
    parts = {f"key_{c}": F.shiftright("_key", s).bitwiseAND((1 << size) - 1).bitwiseAND(mask).cast("int") for c, s in zip("rgb", (2 * size, size, 0))}
    return chosen.withColumns(parts).drop("_key")


def palettes(pixels: DataFrame) -> DataFrame:
    """(image, idx, r, g, b, a): the colours of images with at most 256 of them, by first appearance (least pos)."""
    found = distinct_colours(pixels)
    mine = Window.partitionBy("image")  # MANY rows at most
    kept = found.withColumn("_n", F.count(F.lit(1)).over(mine)).where(F.col("_n") < MANY)
    channel = {c: (F.shiftright("code", s).bitwiseAND(255)).cast("int") for c, s in zip(("r", "g", "b", "a"), (24, 16, 8, 0))}
    return kept.select("image", (F.row_number().over(mine.orderBy("pos", "code")) - 1).alias("idx"), *(v.alias(c) for c, v in channel.items()))


def indexed(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(image, pos, idx): pixels as places in their image's palette; images without one have no rows."""
    look = palette.select(F.col("image").alias("_image"), "idx", colour_code().alias("_code"))
    rows = pixels.select("image", "pos", colour_code().alias("code"))
    return rows.join(look, F.col("_image").eqNullSafe(F.col("image")) & (F.col("_code") == F.col("code"))).select("image", "pos", "idx")


def index_bits(palette: DataFrame) -> DataFrame:
    """(image, bit_depth): bits of an index, 1, 2, 4 or 8."""
    n = F.max("idx")
    return palette.groupBy("image").agg(F.when(n < 2, 1).when(n < 4, 2).when(n < 16, 4).otherwise(8).cast("int").alias("bit_depth"))


def packed_rows(samples: DataFrame, width: int, by: str = "image") -> DataFrame:
    """(image, y, bytes): rows of ``width`` samples (image, pos, idx, bit_depth) in whole bytes, the first sample highest.

    Samples of a byte are summed in place and the bytes of a row put in order; a row's last
    byte is filled with zeros. pos counts from 0 along the rows.
    """
    x = F.expr(f"pos % {width}")
    rows = samples.select(by, F.expr(f"pos div {width}").alias("y"), x.alias("x"), "idx", "bit_depth")
    place = F.expr("(x * bit_depth) div 8")
    moved = F.expr("shiftleft(cast(idx AS int), cast(8 - bit_depth - (x * bit_depth) % 8 AS int))")
    parts = rows.groupBy(by, "y", place.alias("at")).agg(F.sum(moved).alias("byte"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "byte"))), lambda p: F.lpad(F.hex(p["byte"]), 2, "0")), "")
    return parts.groupBy(by, "y").agg(F.unhex(text).alias("bytes"))


def unpacked_rows(rows: DataFrame, width: int, by: str = "image") -> DataFrame:
    """(image, pos, idx) of ``packed_rows`` rows (image, y, bytes, bit_depth)."""
    each = rows.select(by, "y", "bytes", "bit_depth", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    byte = F.conv(F.hex(F.substring("bytes", F.expr("(x * bit_depth) div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    value = F.expr("shiftright(byte, cast(8 - bit_depth - (x * bit_depth) % 8 AS int)) & (shiftleft(1, bit_depth) - 1)")
    return each.withColumn("byte", byte).where("byte IS NOT NULL").select(by, (F.col("y") * width + F.col("x")).alias("pos"), value.alias("idx"))
