"""Packing documents into sequences: shortest-pack-first over the length histogram.

1. Tokenise every document and cut it at ``size`` ids; the pieces (without their ids)
   are written once.
2. Count pieces by length: at most ``size`` rows, whatever the input.
3. On the driver, place lengths longest first. A length goes to the open pattern with
   the most space left (the shortest pack); a pattern is a list of lengths with a count
   of packs, so a step places many pieces at once.
4. Each pattern's slots become intervals of ranks within a length; pieces are ranked
   within their length and look their interval up. Sequences without any space left are
   not padded, nor are those whose length is a power of two.

Ranks within a length are sums of earlier hash buckets' counts and the rank within the
bucket, so a length that a third of all documents share is not ordered in one task.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.staging import Stage

SIZE = 4096
END_ID = 2
#: Word cache of a Python worker; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Texts whose distinct words are found together: about so many bytes, or one text.
RUN_BYTES = 32 << 20


#: A word of plain letters, then marks, is two pre-tokens at most: the lower-cased letters and the marks.
PLAIN = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*)(?P<marks>[-#*$%&.,;:!?()]*)\z"
MARKS = "-#*$%&.,;:!?()"
#: Letters of PLAIN beyond ASCII.
ACCENTED = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]


def _gather(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ``ids[start : start + length]`` in a row."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint32)
    return ids[np.arange(ends[-1]) + np.repeat(start - (ends - length), length)]


class WordTokenizer:
    """Ids of whole texts by way of their words; every distinct word is encoded once (``_encoded``)."""

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.length = np.zeros(1024, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, words: list[bytes]) -> None:
        ids = self._encoded(words)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.at), int(lengths.sum())
        while len(self.length) < n + len(words):
            self.length, self.start = np.resize(self.length, 2 * len(self.length)), np.resize(self.start, 2 * len(self.start))
        while len(self.ids) < self.used + total:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.length[n : n + len(words)] = lengths
        self.start[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total
        self.at.update(zip(words, range(n, n + len(words))))

    def encode_words(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            self._clear()
        if new := set(words).difference(self.at):
            self._learn(list(new))
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return _gather(self.ids, self.start[at], self.length[at])


class BatchTokenizer:
    """Ids of many whole texts at once by way of their distinct words, which Arrow finds.

    The vocabulary's pre-tokeniser drops white space and never looks across it, so a
    text's ids are its words' ids in a row. Words of plain letters and marks go to the
    vocabulary's BPE model by their two pre-tokens, all others through the whole
    tokeniser; both give the tokeniser's own ids, which is tried on every such letter and
    mark when the vocabulary is loaded. A pre-token or other word is encoded once while it
    is in the cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = [(c, bytewise.pre_tokenize_str(c)[0][0]) for c in ACCENTED if c == c.lower()]
        self._clear()
        self.split_here = True
        probes = [f"{a}{c}{b}{m}" for c in [*ACCENTED, *"AZaz"] for a, b, m in (("", "", ""), ("th", "e", ""), ("", "er", ".,"), ("X", "", "!?"))] + [f"{a}{m}" for m in [*MARKS, MARKS] for a in ("", "it")]
        # A vocabulary that lower-cases or splits otherwise goes the whole way for every word.
        if [x.tolist() for x in self.encode(pa.array(probes))] != [e.ids for e in self.tokenizer.encode_batch(probes, add_special_tokens=False)]:
            self.split_here = False
            self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, parts: pa.Array, words: pa.Array) -> None:
        """Append the ids of pre-tokens, then those of whole words, to the cache."""
        ids, lengths = array("I"), array("q")
        joined = "\n".join(parts.to_pylist())
        for c, mapped in self.letters:
            joined = joined.replace(c, mapped)
        for part in joined.split("\n") if len(parts) else ():
            found = [t.id for t in self.model.tokenize(part)] if part else []
            ids.extend(found)
            lengths.append(len(found))
        for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False):
            ids.extend(e.ids)
            lengths.append(len(e.ids))
        length = np.array(lengths, np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
        self.known = pa.concat_arrays([self.known, parts, words])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct pre-tokens and other words are in the cache; new ones are learned."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        if len(new := np.flatnonzero(at < 0)):
            whole = np.ones(len(new), bool)
            if self.split_here:
                whole = ~pc.match_substring_regex(words.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False)
            parts, others = new[~whole], new[whole]
            at[parts], at[others] = np.split(len(self.known) + np.arange(len(new)), [len(parts)])
            self._learn(words.take(pa.array(parts)), words.take(pa.array(others)))
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and where each word's begin and how many there are."""
        if self.split_here:
            split = pc.extract_regex(words, PLAIN)
            head = pc.coalesce(pc.utf8_lower(pc.struct_field(split, "letters")), words)
            each = pa.concat_arrays([head, pc.struct_field(split, "marks").fill_null("")]).dictionary_encode()
            at = self._places(each.dictionary)[each.indices.to_numpy()].reshape(2, -1).T
        else:
            at = self._places(words)[:, None]
        length = self.length[at]
        total = length.sum(axis=1)
        return _gather(self.ids, self.start[at].ravel(), length.ravel()), np.cumsum(total) - total, total

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = texts.fill_null("")
        filled = np.cumsum(pc.binary_length(texts).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(filled // RUN_BYTES)) + 1).tolist(), len(texts)]
        for a, b in pairwise(cuts):
            words = pc.ascii_split_whitespace(texts[a:b])
            coded = words.values.dictionary_encode()
            ids, start, length = self._words(coded.dictionary.cast(pa.string()))
            at, ends = coded.indices.to_numpy(), words.offsets.to_numpy()
            for i, j in pairwise(ends.tolist()):
                mine = at[i:j]
                yield _gather(ids, start[mine], length[mine])


_TOKENIZERS: dict[str, BatchTokenizer] = {}


def _tokenizer(path: str) -> BatchTokenizer:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = BatchTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    Each document is its ids followed by ``end_id``; a null or empty text is that id alone.
    """

    names = ["start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            row, rows = [], []
            for i, ids in enumerate(tokenizer.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    row.append(i)
                    rows.append((at, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int64)] if with_ids else [])))
            columns = [pa.array([r[j] for r in rows], pa.int64() if j < 4 else pa.list_(pa.int64())) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *columns], names=["doc_id", *names])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_packs(counts: dict[int, int], size: int = SIZE) -> pd.DataFrame:
    """Shortest-pack-first: (length, rank_from, n, sequence_from, offset), one row per pattern's run of a length.

    Piece number ``rank_from + i`` of a length (i < n) starts at ``offset`` of sequence
    ``sequence_from + i``.
    """
    # Open patterns by space left; each is [count, ((length, run, pack number in run), ...)].
    open_: dict[int, list] = {}
    spaces: list[int] = []
    slots, sequences, ranks = [], 0, {}

    def put(space: int, first: int, n: int) -> None:
        if space not in open_ or not open_[space]:
            open_[space] = []
            heapq.heappush(spaces, -space)
        open_[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while spaces and not open_.get(-spaces[0]):
                heapq.heappop(spaces)
            space = -spaces[0] if spaces else -1
            if space < length:  # new packs, all of one pattern
                each = size // length
                full, rest = divmod(left, each)
                for packs, deep in ((full, each), (1 if rest else 0, rest)):
                    if packs:
                        for i in range(deep):
                            slots.append((length, ranks.get(length, 0), packs, sequences, i * length))
                            ranks[length] = ranks.get(length, 0) + packs
                        if size - deep * length:
                            put(size - deep * length, sequences, packs)
                        sequences += packs
                left = 0
            else:
                first, n = open_[space].pop()
                took = min(n, left)
                if took < n:
                    open_[space].append((first + took, n - took))
                slots.append((length, ranks.get(length, 0), took, first, size - space))
                ranks[length] = ranks.get(length, 0) + took
                if space > length:
                    put(space - length, first, took)
                left -= took
    return pd.DataFrame(slots, columns=["length", "rank_from", "n", "sequence_from", "offset"], dtype=np.int64)


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with a length column) plus sequence_id and offset; no piece is dropped.

    Equal lengths are ordered by hash bucket, doc_id and start, so reruns agree. An empty
    table packs into nothing.
    """
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(4096)))
    keys = ["length", "__bucket"]
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``size`` rows
    plan = plan_packs(histogram, size)
    runs = {length: tuple(g.sort_values("rank_from")[c].to_numpy() for c in ("rank_from", "sequence_from", "offset")) for length, g in plan.groupby("length")}
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    order = Window.partitionBy(*keys).orderBy("doc_id", "start", *(c for c in ("ids_crc32",) if c in pieces.columns))
    ranked = bucketed.join(offsets, keys).withColumn("__rank", F.row_number().over(order) - 1 + F.col("__before")).drop("__bucket", "__before")
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # slots of patterns: a few for each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, lengths = batch.column("__rank").to_numpy(), batch.column("length").to_numpy()
            sequence, begin = np.zeros((2, batch.num_rows), np.int64)
            by_length = np.argsort(lengths, kind="stable")
            for rows in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
                if len(rows):
                    rank_from, sequence_from, offset = shared.value[int(lengths[rows[0]])]
                    slot = np.searchsorted(rank_from, rank[rows], side="right") - 1
                    sequence[rows] = sequence_from[slot] + rank[rows] - rank_from[slot]
                    begin[rows] = offset[slot]
            yield batch.drop_columns("__rank").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(begin))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("__rank").schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset (and its ids).

    A null text is packed as an empty one, repeated rows each for themselves; a null
    doc_id stays null. Other columns are not carried.
    """
    stage = Stage(docs.sparkSession, "packing")
    pieces = stage.write(token_pieces(docs, tokenizer_path, size, end_id, with_ids), "pieces")
    return pack_pieces(pieces, size)


def padded_length(used: int, size: int = SIZE) -> int:
    """What a sequence of ``used`` ids takes: a power of two is not padded."""
    return used if used & (used - 1) == 0 else size


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_used) from ``pack_documents(..., with_ids=True)``, ids padded by the rule above."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_used"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    full = F.when(F.col("n_used").bitwiseAND(F.col("n_used") - 1) == 0, F.col("n_used")).otherwise(F.lit(size))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id).cast("long"), (full - F.col("n_used")).cast("int"))).alias("ids"), "n_used")
