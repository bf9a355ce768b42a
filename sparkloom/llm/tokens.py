"""Token-id files: ids ranked by frequency in byte-aligned variable-length coding.

1. Every text is encoded once. Ids and their counts come from one pass, and the ids are
   written as they are, so that no text is tokenised twice.
2. Ids are ranked by how often they occur in all documents; the ranks' table has one row
   an id of the vocabulary, whatever the input. Frequent ids take one byte, most others two.
3. Documents are put in order of their ids by range partitions, and a task writes its
   range as one file (below). Its name holds the task attempt; only files named in the
   manifest count, which is written when all tasks are done. A task that is run again leaves at most
   a file that nobody reads.
4. Reading back goes by file: a task walks through the blocks, looks the control bytes up
   in a table of 256 rows and gathers the values without a loop over ids.

A file is the magic, the ids by rank, then blocks of about ``BLOCK_TOKENS`` ids or one
longer document: the counts, doc_ids, null marks and token counts of its documents, the control bytes
and the values. A control byte holds the lengths (less one) of four values in two bits
each; every document begins with a control byte of its own, so documents can be cut out
of a block.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .hashing import text_bytes
from .packing import ACCENTED, MARKS, _gather

END_ID = 2
#: Texts encoded together: about so many bytes, or one text.
RUN_BYTES = 4 << 20
#: Pieces that a worker remembers; beyond it, or beyond their bytes, only those of the run at hand stay.
CACHE_PIECES, CACHE_BYTES = 800_000, 32 << 20
#: Ids of a block of a file.
BLOCK_TOKENS = 1 << 20
MAGIC = b"TOKIDS01"

# Bytes that a space may be cut off before: printable ASCII, and lead bytes that no white space begins with.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xE1] = True
_OPENS[0xE4:0xF5] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True

#: Letters and the marks after them; neither holds an apostrophe, which may begin a contraction.
PLAIN = r"^(?P<letters> ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[-#*$%&.,;:!?()]*)\z"

#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


class PieceTokenizer:
    """Ids of many whole texts at once by way of their distinct pieces, which Arrow finds.

    The byte-level pre-tokeniser puts a space before anything but white space to what
    follows, whatever stands before, and a single line break between other bytes is a
    pre-token; texts are cut there, and a text's ids are the ids of its pieces in a row.
    Letters and the marks after them are two pre-tokens and go to the vocabulary's BPE model;
    all other pieces go through the whole tokeniser. Probes are compared when a vocabulary
    is loaded; where they differ, every piece goes the whole way. What is in the cache
    isn't encoded again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The letter that all the others' mapped forms begin with comes first.
        letters = sorted(ACCENTED, key=lambda c: c != bytewise.pre_tokenize_str(ACCENTED[0])[0][0][0])
        self.mapped = [(c, bytewise.pre_tokenize_str(c)[0][0]) for c in (" ", *letters)]
        self.split = True
        self._clear()
        words = ["the", "The", *(f"{c}t{c}" for c in ACCENTED), *(f"it{m}" for m in (*MARKS, MARKS))]
        probes = ["".join(f"{a}{w}" for w in words) for a in (" ", "\n", ".\n")]
        if [x[0].tolist() for t in probes for x in self.encode(pa.array([t]))] != [e.ids for e in self.tokenizer.encode_batch(probes, add_special_tokens=False)]:
            self.split = False
            self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, words: pa.Array, whole: bool) -> tuple[array, array]:
        """The words' ids in a row, and how many each has."""
        ids, lengths = array("I"), array("q")
        if whole:
            for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False):
                ids.extend(e.ids)
                lengths.append(len(e.ids))
            return ids, lengths
        mapped = "\n".join(words.to_pylist())
        for c, to in self.mapped:
            mapped = mapped.replace(c, to)
        for word in mapped.split("\n"):
            found = [t.id for t in self.model.tokenize(word)] if word else ()
            ids.extend(found)
            lengths.append(len(found))
        return ids, lengths

    def _places(self, words: pa.Array, whole: np.ndarray) -> np.ndarray:
        """Where distinct pre-tokens, or pieces that go the whole way, are in the cache; new ones are learned."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        if len(self.known) > CACHE_PIECES or self.known.nbytes > CACHE_BYTES:
            at = self._keep(at)
        for kind in (False, True):
            if len(new := np.flatnonzero((at < 0) & (whole == kind))):
                fresh = words.take(pa.array(new))
                ids, lengths = self._encoded(fresh, kind)
                length = np.array(lengths, np.int64)
                at[new] = len(self.known) + np.arange(len(new))
                self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
                self.length = np.concatenate([self.length, length])
                self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
                self.known = pa.concat_arrays([self.known, fresh])
        return at

    def _keep(self, at: np.ndarray) -> np.ndarray:
        """Drop what isn't at the places ``at``; returns the new places."""
        kept = np.unique(at[at >= 0])
        self.ids = _gather(self.ids, self.start[kept], self.length[kept])
        self.length = self.length[kept]
        self.start = np.cumsum(self.length) - self.length
        self.known = self.known.take(pa.array(kept))
        return np.where(at < 0, -1, np.searchsorted(kept, at))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row, and where each piece's begin and how many there are."""
        if self.split:
            parts = pc.extract_regex(pieces, PLAIN)
            odd = pc.is_null(parts).to_numpy(zero_copy_only=False)
            each = pa.concat_arrays([pc.coalesce(pc.struct_field(parts, "letters"), pieces), pc.struct_field(parts, "marks").fill_null("")]).dictionary_encode()
            code = each.indices.to_numpy()
            whole = np.zeros(len(each.dictionary), bool)
            whole[code[: len(pieces)][odd]] = True
            at = self._places(each.dictionary, whole)[code].reshape(2, -1).T
        else:
            at = self._places(pieces, np.ones(len(pieces), bool))[:, None]
        length = self.length[at]
        total = length.sum(axis=1)
        return _gather(self.ids, self.start[at].ravel(), length.ravel()), np.cumsum(total) - total, total

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of runs of texts; a null text is empty."""
        for data, bounds in text_bytes(texts, RUN_BYTES):
            cut = np.zeros(len(data) + 1, bool)
            if len(data) > 2:
                opens = _OPENS[data]
                cut[: len(data) - 1] = (data[:-1] == 0x20) & opens[1:]
                line = np.flatnonzero((data[1:-1] == 0x0A) & _PRINTED[data[:-2]] & opens[2:]) + 1
                cut[line] = cut[line + 1] = True
            cut[bounds[1:][bounds[1:] > 0] - 1] = False  # what follows is another text's
            cut[bounds] = True
            starts = np.flatnonzero(cut[:-1])
            offsets = np.append(starts, len(data)).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
            coded = pieces.dictionary_encode()
            ids, start, length = self._pieces(coded.dictionary)
            at = coded.indices.to_numpy()
            total = np.append(0, np.cumsum(length[at]))
            yield _gather(ids, start[at], length[at]), total[np.searchsorted(starts, bounds)]


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): each text's ids and ``end_id`` as little-endian 32-bit integers.

    A null or empty text is ``end_id`` alone. The strings of the vocabulary's special tokens
    are those tokens, as the tokeniser has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            at = 0
            for ids, bounds in tokenizer.encode(batch.column("text")):
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(np.diff(bounds)), _binary(ids.view(np.uint8), bounds * 4)], names=["doc_id", "n_tokens", "ids"])
                at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Byte strings that lie in a row."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of byte strings without nulls."""
    _, places, content = column.buffers()
    bounds = np.frombuffer(places, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(content if content is not None else b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; ids are below ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_flat(batch.column("ids"))[0].view("<u4"), minlength=vocabulary)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row an id of the vocabulary
        out[r.id] = r.n
    return out


def rank_order(counts: np.ndarray) -> np.ndarray:
    """The ids that occur, most frequent first, equal ones by id: the id of each rank."""
    order = np.argsort(-counts, kind="stable")
    return order[: int((counts > 0).sum())].astype("<u4")


def pack_values(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control, control bounds, data, data bounds) of runs of ``counts`` values below 2**32."""
    values = values.astype("<u4")
    size = (1 + (values >= 1 << 8) + (values >= 1 << 16).astype(np.int64) + (values >= 1 << 24)).astype(np.int64)
    slots = -(-counts // 4)
    ends, bounds = np.cumsum(slots), np.append(0, np.cumsum(counts))
    place = np.arange(len(values)) + np.repeat((ends - slots) * 4 - bounds[:-1], counts)
    codes = np.zeros(int(slots.sum()) * 4, np.uint8)
    codes[place] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control, np.append(0, ends), data, np.append(0, np.cumsum(size))[bounds]


def unpack_values(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of ``pack_values``: lengths come from a table of the 256 control bytes."""
    slots = -(-counts // 4)
    size = LENGTHS[control].ravel()
    ends = np.cumsum(slots)
    bounds = np.cumsum(counts)
    used = np.arange(int(counts.sum())) + np.repeat((ends - slots) * 4 - (bounds - counts), counts)
    size = size[used]
    at = np.cumsum(size) - size
    values = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        values[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _coded(tokens: DataFrame, order: np.ndarray, vocabulary: int) -> DataFrame:
    """(doc_id, n_tokens, control, data) in the files' coding."""
    rank = np.zeros(vocabulary, np.uint32)
    rank[order] = np.arange(len(order))
    shared = tokens.sparkSession.sparkContext.broadcast(rank)  # four bytes an id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = batch.column("n_tokens").to_numpy()
                control, c, data, d = pack_values(shared.value[_flat(batch.column("ids"))[0].view("<u4")], counts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), _binary(control, c), _binary(data, d)], names=["doc_id", "n_tokens", "control", "data"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, control binary, data binary")


def _open_store(path: str):
    """The store that holds ``path``, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_files(tokens: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """Write ``token_ids`` rows as files under ``path`` in ascending order of doc_id; returns the manifest.

    ``path`` is a URI (file, hdfs, s3, gs) that driver and executors open. The manifest
    (shard, file, n_docs, n_tokens, start; start: ids of all files before) has a row a file and is written as Parquet beside them. A null doc_id
    comes first; rows with one doc_id are ordered by length and coded bytes. An empty table
    gives no files.
    """
    order = rank_order(id_counts(tokens, vocabulary))
    ranks = tokens.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_store(path)
        shard, docs, total, out = TaskContext.get().partitionId(), 0, 0, None
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
        try:
            for batch in batches:
                counts = batch.column("n_tokens").to_numpy()
                block = (np.cumsum(counts) - counts) // BLOCK_TOKENS
                for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(block)) + 1):
                    if not len(rows):
                        continue
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + struct.pack("<Q", len(ranks.value)) + ranks.value.tobytes())
                    part = batch.slice(int(rows[0]), len(rows))
                    ids, control, data = part.column("doc_id"), _flat(part.column("control"))[0], _flat(part.column("data"))[0]
                    out.write(struct.pack("<QQQ", len(rows), len(control), len(data)))
                    out.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                    out.write(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                    out.write(counts[rows].astype("<u8").tobytes())
                    out.write(control.tobytes())
                    out.write(data.tobytes())
                docs, total = docs + len(counts), total + int(counts.sum())
        finally:
            if out is not None:
                out.close()
        if docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": docs, "n_tokens": total}], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    keys = ["doc_id", "n_tokens", "control", "data"]
    coded = _coded(tokens, order, vocabulary).repartitionByRange("doc_id", "n_tokens", F.xxhash64("control", "data"), F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    spark = tokens.sparkSession
    schema = "shard long, file string, n_docs long, n_tokens long"
    coded.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/_written")
    files = spark.read.schema(schema).parquet(f"{path}/_written")  # a row a file
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", start).write.mode("overwrite").parquet(f"{path}/_manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard long, file string, n_docs long, n_tokens long, start long").parquet(f"{path}/_manifest")


def _take(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("a token file ends early")
    return data


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids) of each document in the files of the manifest.

    start counts the ids of all documents before it; ids_crc32 is of the ids as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_store(path)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with store.open_input_stream(f"{root}/{row['file']}") as f:
                    if _take(f, len(MAGIC)) != MAGIC:
                        raise ValueError(f"{row['file']} is no token file")
                    order = np.frombuffer(_take(f, 4 * struct.unpack("<Q", _take(f, 8))[0]), "<u4")
                    while head := f.read(24):
                        n, n_control, n_data = struct.unpack("<QQQ", head)
                        ids, null = np.frombuffer(_take(f, 8 * n), "<i8"), np.frombuffer(_take(f, n), np.uint8)
                        counts = np.frombuffer(_take(f, 8 * n), "<u8").astype(np.int64)
                        control, data = np.frombuffer(_take(f, n_control), np.uint8), np.frombuffer(_take(f, n_data), np.uint8)
                        values = order[unpack_values(control, data, counts)]
                        bounds = np.append(0, np.cumsum(counts))
                        content = memoryview(values.view(np.uint8))
                        crc = np.array([zlib.crc32(content[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], np.int64)
                        columns = [pa.array(ids, mask=null.astype(bool)), pa.array(start + bounds[:-1]), pa.array(counts), pa.array(crc)]
                        if with_ids:
                            columns.append(pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int64))).cast(pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                        start += int(bounds[-1])

    manifest = read_manifest(spark, path)
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.select("shard", "file", "start").repartitionByRange(n, "shard").mapInArrow(run, schema)


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode all documents and write their files under ``path``; returns the manifest (``write_files``).

    A null or empty text is ``end_id`` alone; a document of any length is one block of its
    file. Repeated rows are documents of their own; other columns are not carried.
    """
    stage = Stage(docs.sparkSession, "token-ids")
    tokens = stage.write(token_ids(docs, tokenizer_path, end_id), "ids")
    manifest = write_files(tokens, path, max(vocabulary_size(tokenizer_path), end_id + 1))
    stage.only()
    return manifest


def new_path(spark: SparkSession) -> str:
    """A folder for files in the shared folder; it goes with the JVM."""
    return Stage(spark, "token-files").root
