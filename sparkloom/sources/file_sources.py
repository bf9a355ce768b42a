"""Spark data sources: edge files with a header that is right by construction, and PNG chunk tables.

Both are registered by ``register``, and open files through ``pyarrow.fs``: a path is a URI
(file, hdfs, s3, gs) or a local path that driver and executors open.

    register(spark)
    spark.read.format("edge_file").load(path)
    edges.write.format("edge_file").option("nodes", n).mode("overwrite").save(path)
    spark.read.format("png_chunks").option("check", "false").load(path)
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sparkloom.staging import Stage

from . import png
from .edgelist import read_header

#: Bytes of an edge file that a task reads, and files of which it lists the chunks.
SPLIT = 64 << 20
FILES = 64
#: Bytes that are parsed at once.
PIECE = 8 << 20


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}")


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the visible files under a folder."""
    store, root = _open(path)
    found = store.get_file_info(root)
    if found.type == FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == FileType.File:
        return [(root, found.size)]
    below = store.get_file_info(FileSelector(root, recursive=True))
    hidden = lambda name: any(part[0] in "._" for part in name[len(root) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in below if f.type == FileType.File and not hidden(f.path))


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, int]]

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class EdgeFiles(DataSource):
    """Rows (u, v, w) of ``;``-separated edge files; the header and other tags are skipped."""

    @classmethod
    def name(cls) -> str:
        return "edge_file"

    def schema(self) -> str:
        return "u long, v long, w long"

    def reader(self, schema) -> DataSourceReader:
        return EdgeReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema.fields] != ["u", "v", "w"]:
            raise ValueError("an edge file has the columns u, v and w")
        return EdgeWriter(self.options["path"], self.options.get("nodes"), overwrite)


class EdgeReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [Part([(f, at, min(at + self.split, size))]) for f, size in _files(self.path) for at in range(0, size, self.split)] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin within the range, a piece at a time."""
        store, _ = _open(self.path)
        for name, begin, end in partition.files:
            with store.open_input_file(name) as f:
                at, rest = max(0, begin - 1), b""
                f.seek(at)
                if begin:  # the line that the byte before belongs to is another task's
                    at += len(_line(f))
                while at < end:
                    piece = f.read(min(PIECE, end - at))
                    if at + len(piece) >= end and not piece.endswith(b"\n"):
                        piece += _line(f)
                    if not piece:
                        break
                    at += len(piece)
                    lines, newline, last = (rest + piece).rpartition(b"\n")
                    rest = last
                    yield from _parsed(lines + newline)
                yield from _parsed(rest)


def _line(f) -> bytes:
    """What is left of a line, with its end."""
    out = b""
    while piece := f.read(4096):
        end = piece.find(b"\n")
        if end >= 0:
            f.seek(f.tell() - len(piece) + end + 1)
            return out + piece[: end + 1]
        out += piece
    return out


def _parsed(lines: bytes) -> Iterator[pa.RecordBatch]:
    if not lines.strip():
        return
    names = ["tag", "u", "v", "w"]
    types = {"tag": pa.string(), "u": pa.int64(), "v": pa.int64(), "w": pa.int64()}
    table = csv.read_csv(io.BytesIO(lines), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(delimiter=";", quote_char=False), csv.ConvertOptions(column_types=types))
    yield from table.filter(pc.equal(table["tag"], "E")).select(names[1:]).to_batches()


class EdgeWriter(DataSourceArrowWriter):
    """Parts are written aside and appear with the header, whose number of edges is the sum of the parts', once all are done.

    What a failed or repeated task has written is not among the parts and goes. A write that
    fails leaves the folder as it was.
    """

    def __init__(self, path: str, nodes: str | None, overwrite: bool):
        self.path, self.nodes, self.overwrite, self.job = path, nodes, overwrite, uuid.uuid4().hex
        if nodes is None:
            raise ValueError("the option nodes, the number of vertices, is missing")

    def _aside(self) -> tuple[FileSystem, str, str]:
        store, root = _open(self.path)
        return store, root, f"{root.rstrip('/')}/_aside-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, aside = self._aside()
        rows, name, out = 0, f"part-{uuid.uuid4().hex}.csv", None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if any(c.null_count for c in batch.columns):
                    raise ValueError("an edge file has no nulls")
                if out is None:
                    store.create_dir(aside, recursive=True)
                    out = store.open_output_stream(f"{aside}/{name}")
                parts = pc.binary_join_element_wise("E", *(c.cast(pa.string()) for c in batch.columns), ";")
                out.write("".join(f"{line}\n" for line in parts.to_pylist()).encode())
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, aside = self._aside()
        old = [] if store.get_file_info(root).type == FileType.NotFound else [f for f, _ in _files(self.path)]
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has an edge file already; use the mode overwrite")
        store.create_dir(aside, recursive=True)
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{aside}/head.csv") as f:
            f.write(f"H;{int(self.nodes)};{sum(m.rows for m in done)};1\n".encode())
        for name in old:
            store.delete_file(name)
        for name in ["head.csv", *(m.name for m in done if m.name)]:
            store.move(f"{aside}/{name}", f"{root}/{name}")
        store.delete_dir(aside)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, aside = self._aside()
        if store.get_file_info(aside).type != FileType.NotFound:
            store.delete_dir(aside)


class PngChunks(DataSource):
    """Rows of ``png.CHUNKS``; with the option check=false the chunks' bodies are not read, and crc_ok is null."""

    @classmethod
    def name(cls) -> str:
        return "png_chunks"

    def schema(self) -> str:
        return png.CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options["path"], self.options.get("check", "true").lower() == "true")


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, check: bool):
        self.path, self.check = path, check

    def partitions(self) -> list[InputPartition]:
        files = [(f, 0, size) for f, size in _files(self.path)]
        return [Part(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for name, _, size in partition.files:
            with store.open_input_file(name) as f:

                def take(at: int, n: int, f=f) -> bytes:
                    f.seek(at)
                    return f.read(n)

                yield from png.chunk_rows(name, take, size, self.check)


def register(spark: SparkSession) -> None:
    for source in (EdgeFiles, PngChunks):
        spark.dataSource.register(source)


def write_edge_files(edges: DataFrame, path: str) -> DataFrame:
    """Write (u, v, w) by the source, the vertices counted from the same rows; returns the header (num_nodes, num_edges, direction)."""
    spark = edges.sparkSession
    register(spark)
    rows = Stage(spark, "edge-source").write(edges.select(*(F.col(c).cast("long").alias(c) for c in ("u", "v", "w"))), "edges")
    nodes = rows.select(F.explode(F.array("u", "v")).alias("id")).distinct().count()
    rows.write.format("edge_file").option("nodes", nodes).mode("overwrite").save(path)
    return read_header(spark, path)
