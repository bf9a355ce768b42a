"""PNG files from pixel tables: the cheapest colour model, chosen filters, one file an image."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import colour, scanlines
from sparkloom.staging import Stage

from .png import SIGNATURE

#: Channels of the models with whole bytes.
WHOLE = {colour.GREY: ("r",), colour.RGB: ("r", "g", "b"), colour.GREY_ALPHA: ("r", "a"), colour.RGBA: ("r", "g", "b", "a")}


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _model_rows(pixels: DataFrame, models: DataFrame, palette: DataFrame, width: int, strategy: str) -> DataFrame:
    """(image, y, filter, bytes) of every row of every image under its model."""
    depth = models.select("image", "bit_depth")
    indexed = colour.indexed(pixels, palette).join(depth, "image")
    small = pixels.join(models.where((F.col("color_type") == colour.GREY) & (F.col("bit_depth") < 8)).select("image", "bit_depth"), "image")
    small = small.select("image", "pos", F.expr("r * (shiftleft(1, bit_depth) - 1) div 255").cast("int").alias("idx"), "bit_depth")
    # What isn't whole bytes a sample has no filter.
    rows = colour.packed_rows(indexed.unionByName(small), width).select("image", "y", F.lit(0).alias("filter"), "bytes")
    for kind, names in WHOLE.items():
        mine = pixels.join(models.where((F.col("color_type") == kind) & (F.col("bit_depth") == 8)).select("image"), "image", "left_semi")
        lines = mine.groupBy("image", F.expr(f"pos div {width}").alias("y")).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("all"))  # one row of pixels
        lines = lines.select("image", "y", F.expr(f"flatten(transform(all, p -> array({', '.join(f'p.{c}' for c in names)})))").alias("line"))
        done = scanlines.filtered_rows(lines, scanlines.choose_filters(lines, len(names), strategy), len(names))
        text = F.array_join(F.transform("line", lambda v: F.lpad(F.hex(v), 2, "0")), "")
        rows = rows.unionByName(done.select("image", F.col("y").cast("long").alias("y"), "filter", F.unhex(text).alias("bytes")))
    return rows


def _dealt_rows(pixels: DataFrame, width: int, strategy: str) -> DataFrame:
    """(image, y, head, filter, bytes): each image's head, then its rows in order, in one task."""
    stage = Stage(pixels.sparkSession, "png-encode")
    pixels = stage.write(pixels.where("image IS NOT NULL").select("image", F.col("pos").cast("long").alias("pos"), "r", "g", "b", "a"), "pixels")
    models = stage.write(colour.choose_model(colour.colour_stats(pixels)), "models")
    chosen = models.where(F.col("color_type") == colour.PALETTE).select("image")
    palette = stage.write(colour.palettes(pixels.join(chosen, "image", "left_semi")), "palettes")
    rows = stage.write(_model_rows(pixels, models, palette, width, strategy), "rows")
    colours = palette.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b", "a"))).alias("palette"))  # 256 at most
    heads = models.select("image", "n_pixels", "color_type", "bit_depth", "key_r", "key_g", "key_b").join(colours, "image", "left")
    heads = heads.select("image", F.lit(-1).cast("long").alias("y"), F.struct(*heads.columns[1:]).alias("head"))
    return heads.unionByName(rows, allowMissingColumns=True).repartition("image").sortWithinPartitions("image", "y")


def _made(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(image, content) from ``_dealt_rows``."""

    def made(done: list[tuple], names: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], names), pa.array([c for _, c in done], pa.binary())], names=["image", "content"])

    image = None
    for batch in batches:
        done: list[tuple] = []
        names, ys, heads = batch.column("image"), batch.column("y").to_pylist(), batch.column("head")
        for i, (y, number, row) in enumerate(zip(ys, batch.column("filter").to_pylist(), batch.column("bytes"))):
            if y < 0:
                if image:
                    done.append(image.file())
                image = _Image(names[i].as_py(), heads[i].as_py(), width)
            else:
                image.add(number, row.as_py())
        if done:
            yield made(done, names.type)
    if image:
        yield made([image.file()], names.type)


def _stored(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """(image, path) of written (image, content)."""
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    for batch in batches:
        paths = []
        for name, content in zip(batch.column("image"), batch.column("content")):
            part, done = f"{root}/.{uuid.uuid4().hex}", f"{root}/{str(name.as_py()).replace('/', '_')}.png"
            with store.open_output_stream(part) as f:
                f.write(content.as_buffer())
            store.move(part, done)
            paths.append(done)
        yield pa.RecordBatch.from_arrays([batch.column("image"), pa.array(paths, pa.string())], names=["image", "path"])


def encode_images(pixels: DataFrame, width: int, strategy: str = "minsum") -> DataFrame:
    """(image, content): a PNG file of each image of (image, pos, r, g, b, a), eight bits a channel, rows of ``width`` pixels.

    pos counts from 0 and has no gaps; an image whose last row isn't full stops the write. A
    file is made in one task, as it is read in one, from rows that pass one by one; statistics,
    palettes and filters are not.
    A null image has no file.
    """
    return _dealt_rows(pixels, width, strategy).mapInArrow(lambda batches: _made(batches, width), f"image {dict(pixels.dtypes)['image']}, content binary")


class _Image:
    """A file that is made as its rows pass; only what is compressed is held."""

    def __init__(self, name, head: dict, width: int):
        self.name, self.head, self.width = name, head, width
        self.height, self.rest = divmod(head["n_pixels"], width)
        self.rows, self.packer, self.packed = 0, zlib.compressobj(), []

    def add(self, number: int, row: bytes) -> None:
        self.packed.append(self.packer.compress(bytes([number]) + row))
        self.rows += 1

    def file(self) -> tuple:
        head = self.head
        if self.rest or self.rows != self.height:
            raise ValueError(f"image {self.name} has no whole rows of {self.width} pixels")
        parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", self.width, self.height, head["bit_depth"], head["color_type"], 0, 0, 0))]
        if head["color_type"] == colour.PALETTE:
            colours = head["palette"]
            parts.append(chunk(b"PLTE", b"".join(bytes((p["r"], p["g"], p["b"])) for p in colours)))
            clear = bytes(p["a"] for p in colours).rstrip(b"\xff")
            if clear:
                parts.append(chunk(b"tRNS", clear))
        elif head["key_r"] is not None:
            key = [head[c] for c in ("key_r", "key_g", "key_b")]
            parts.append(chunk(b"tRNS", struct.pack(">H", key[0]) if head["color_type"] == colour.GREY else struct.pack(">3H", *key)))
        body = b"".join([*self.packed, self.packer.flush()])
        return self.name, SIGNATURE + b"".join([*parts, chunk(b"IDAT", body), chunk(b"IEND", b"")])


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (image, content) as ``folder``/image.png from the tasks; returns (image, path).

    ``folder`` is a URI (file, hdfs, s3, gs) that all executors open. A file is written under
    a name of its own and then renamed, so a task that is run again or lost leaves no half file in its place.
    """

    written = files.select("image", "content").mapInArrow(lambda batches: _stored(batches, folder), f"image {dict(files.dtypes)['image']}, path string")
    return Stage(files.sparkSession, "png-files").write(written, "written")


def write_images(pixels: DataFrame, width: int, folder: str, strategy: str = "minsum") -> DataFrame:
    """``write_files`` of ``encode_images`` by one Python worker a task; the two calls keep two, one behind the other."""
    schema = f"image {dict(pixels.dtypes)['image']}, path string"
    written = _dealt_rows(pixels, width, strategy).mapInArrow(lambda batches: _stored(_made(batches, width), folder), schema)
    return Stage(pixels.sparkSession, "png-files").write(written, "written")
