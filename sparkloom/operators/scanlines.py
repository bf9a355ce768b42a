"""Scanline filters and interlacing of images as expressions over rows and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.png import PASSES

#: Rows of an image that are filtered in one window.
BAND = 1024
FILTERS = ("none", "left", "above", "average", "paeth")


def with_line_above(rows: DataFrame, by: str = "image") -> DataFrame:
    """(image, y, line, above): each row of bytes with the one at y - 1; null above the first.

    Images are dealt in bands of ``BAND`` rows, and a band also gets the row before it, so no
    window holds a whole image. Rows are expected for every y from 0.
    """
    y, band = F.col("y").cast("long"), F.expr(f"cast(y AS long) div {BAND}")
    bands = F.when(y % BAND == BAND - 1, F.array(band, band + 1)).otherwise(F.array(band))
    lines = rows.select(by, y.alias("y"), "line", band.alias("_own"), F.explode(bands).alias("_band"))
    place = Window.partitionBy(by, "_band").orderBy("y")
    return lines.withColumn("above", F.lag("line").over(place)).where("_own = _band").drop("_own", "_band")


def _bytes_of(rows: DataFrame, step: int, by: str) -> DataFrame:
    """(image, y, bytes): each row's bytes as structs (value, left, above, corner), neighbours outside the image being 0."""
    lines = with_line_above(rows, by).where(F.size("line") > 0)
    zero = F.lit(0)
    none = F.array_repeat(zero, F.lit(step))
    above = F.coalesce("above", F.transform("line", lambda v: zero))
    # Neighbours on the left are the same row, moved to the right by a pixel.
    zipped = F.arrays_zip(F.col("line").alias("value"), F.concat(none, F.col("line")).alias("left"), above.alias("above"), F.concat(none, above).alias("corner"))
    return lines.select(by, "y", F.slice(zipped, F.lit(1), F.size("line")).alias("bytes"))


def predicted(left: Column, above: Column, corner: Column) -> list[Column]:
    """What each of the five filters expects of a byte."""
    base = left + above - corner
    by_left, by_above, by_corner = F.abs(base - left), F.abs(base - above), F.abs(base - corner)
    paeth = F.when((by_left <= by_above) & (by_left <= by_corner), left).when(by_above <= by_corner, above).otherwise(corner)
    return [F.lit(0), left, above, F.shiftright(left + above, 1), paeth]


def _residuals(kind: int) -> Column:
    """The row's bytes under a filter, an array; a row's work stays in its task, however many bytes it has."""
    guess = lambda p: predicted(p["left"], p["above"], p["corner"])[kind]
    return F.transform("bytes", lambda p: ((p["value"] - guess(p) + 256) % 256).cast("int"))


def filter_sums(rows: DataFrame, step: int, by: str = "image") -> DataFrame:
    """(image, y, s0 ... s4): each row's summed residuals by filter; differences count as signed, -1 as 0 and so on."""

    def total(kind: int) -> Column:
        signed = lambda v: v if kind == 0 else F.when(v < 128, v).otherwise(255 - v)
        return F.aggregate(_residuals(kind), F.lit(0).cast("long"), lambda s, v: s + F.coalesce(signed(v), F.lit(0)))

    return _bytes_of(rows, step, by).select(by, "y", *(total(i).alias(f"s{i}") for i in range(5)))


def filter_entropies(rows: DataFrame, step: int, by: str = "image") -> DataFrame:
    """(image, y, s0 ... s4): each row's summed n * log2(n) over its byte counts by filter, linear between powers of two.

    The filter's own number, which stands before the row, is one of its bytes. A byte that m
    equal ones precede adds what the m + 1st adds to the term, floor(log2(m)) + 2.
    """
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("m"), F.lit(0).cast("long").alias("s"))

    def add(t: Column, v: Column) -> Column:
        again = F.struct(v.alias("last"), (t["m"] + 1).alias("m"), (t["s"] + F.length(F.bin(t["m"])) + 1).alias("s"))
        return F.when(v.eqNullSafe(t["last"]), again).otherwise(F.struct(v.alias("last"), F.lit(1).alias("m"), t["s"].alias("s")))

    ordered = (F.sort_array(F.concat(_residuals(i), F.array(F.lit(i)))) for i in range(5))
    sums = [F.aggregate(v, start, add, lambda t: t["s"]) for v in ordered]
    return _bytes_of(rows, step, by).select(by, "y", *(s.alias(f"s{i}") for i, s in enumerate(sums)))


def choose_filters(rows: DataFrame, step: int, strategy: str = "minsum", by: str = "image") -> DataFrame:
    """(image, y, filter): the filter of each row of bytes (image, y, line); of equal ones the lowest number.

    ``step`` is the bytes of a pixel, at least 1. "minsum" takes the least ``filter_sums``,
    "entropy" the greatest ``filter_entropies``. Rows without bytes have no result.
    """
    if strategy == "minsum":
        sums = filter_sums(rows, step, by)
        best = F.array_min(F.array(*(F.struct(F.col(f"s{i}").alias("s"), F.lit(i).alias("filter")) for i in range(5))))
    elif strategy == "entropy":
        sums = filter_entropies(rows, step, by)
        best = F.array_min(F.array(*(F.struct((-F.col(f"s{i}")).alias("s"), F.lit(i).alias("filter")) for i in range(5))))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return sums.select(by, "y", best["filter"].alias("filter"))


def filtered_rows(rows: DataFrame, filters: DataFrame, step: int, by: str = "image") -> DataFrame:
    """(image, y, filter, line): the rows under their filters, as a decoder expects them."""
    chosen = filters.select(F.col(by).alias("_by"), F.col("y").alias("_y"), "filter")
    joined = _bytes_of(rows, step, by).join(chosen, F.col(by).eqNullSafe(F.col("_by")) & (F.col("y") == F.col("_y")))
    line = F.when(F.col("filter") == 0, _residuals(0))
    for i in range(1, 5):
        line = line.when(F.col("filter") == i, _residuals(i))
    return joined.select(by, "y", "filter", line.alias("line"))


def _side(size: Column, start: int, step: int) -> Column:
    """Pixels of a pass along one side."""
    return F.greatest(F.lit(0), F.floor((size - start + step - 1) / step)).cast("long")


def interlaced_place(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Struct (pass from 1, place) of a pixel in the order of an interlaced image, in closed form."""
    before, out = F.lit(0).cast("long"), None
    for number, (x0, y0, dx, dy) in enumerate(PASSES, 1):
        w, h = _side(width, x0, dx), _side(height, y0, dy)
        mine = (x % dx == x0) & (y % dy == y0)
        at = before + ((y - y0) / dy).cast("long") * w + ((x - x0) / dx).cast("long")
        here = F.struct(F.lit(number).alias("pass"), at.alias("place"))
        out = F.when(mine, here) if out is None else out.when(mine, here)
        before = before + w * h
    return out


def interlaced_pixel(place: Column, width: Column, height: Column) -> Column:
    """Struct (x, y) of the pixel at a place of an interlaced image: the inverse of ``interlaced_place``."""
    before, out = F.lit(0).cast("long"), None
    for x0, y0, dx, dy in PASSES:
        w, h = _side(width, x0, dx), _side(height, y0, dy)
        rest = place - before
        row = F.floor(rest / F.nullif(w, F.lit(0))).cast("long")
        here = F.struct((F.lit(x0) + (rest - row * w) * dx).cast("long").alias("x"), (F.lit(y0) + row * dy).cast("long").alias("y"))
        mine = (rest >= 0) & (rest < w * h)
        out = F.when(mine, here) if out is None else out.when(mine, here)
        before = before + w * h
    return out


def interlace(pixels: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``pixels`` (with x, y, width and height) plus pass and place; a permutation within each image."""
    found = interlaced_place(F.col("x"), F.col("y"), F.col(width), F.col(height))
    return pixels.withColumn("_i", found).select("*", F.col("_i.pass").alias("pass"), F.col("_i.place").alias("place")).drop("_i")
