"""Removal of repeated passages: depth-limited radix sort of windows.

Two windows (suffixes cut at ``depth`` bytes) belong together if all their bytes agree.
Windows are split by most-significant-digit passes, and a window whose group has shrunk
to itself leaves at once; the groups left after the last digit are exactly the repeated
windows. Sorting every suffix would move many times the input, so windows are handled in
runs and the digits are taken in an order that suits runs:

* First digit: the window's anchor, the ``gram``-byte string with the least hash among
  all those in the window (leftmost of equals). Equal windows have equal anchors at equal
  offsets. Neighbouring windows share their anchor, so about one run for each 140 bytes
  stands for them all.
* Following digits: the offset's interval and the bytes that all windows of the interval
  share, in passes from wide to narrow intervals (``WIDTHS``), down to single windows and
  all their bytes.
* A run whose whole stretch (all bytes of all its windows) occurs twice is repeated as it
  is and needs no more passes; one representative stays in the sort as partner for others.

Runs count as equal by the BLAKE2b-128 digest of all their bytes; the digits that deal them
into groups are plain hashes, which can only bring unequal runs together. Groups are only counted, by aggregation with partial sums, and joined back; no task sees
all members of a group, however large.

Passages of over 50 words that occur in another document too can be shorter than ``DEPTH``
bytes. They are marked, not removed: the same passes go over windows of words, the anchor
being a string of ``WORD_GRAM`` words, and end for a document with its first shared run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .hashing import digests, mixed, window_hashes, word_hashes

DEPTH = 400
GRAM = 128
#: Interval widths of the passes after the first.
WIDTHS = (35, 5, 1)
#: Windows handled at once within a text; longer texts go in several segments.
SEGMENT = 1 << 20
#: Words of the shortest passage that is marked, and of its anchor.
PASSAGE = 51
WORD_GRAM = 12
#: Word windows of a text handled at once; longer texts go in several segments.
WORD_SEGMENT = 1 << 16

_TABLE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    global _POWERS
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        _POWERS = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS


class Hashes:
    """Hashes of any substrings of one byte string. Equal strings have equal hashes, but others
    can be made to share one: only digits are taken from them, never equality."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverses = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverses[start])


def _anchors(digit: np.ndarray, wide: int) -> np.ndarray:
    """For each window of ``wide`` grams the place of its least hash, by prefix and suffix minima of blocks.

    The position in the low bits makes it the leftmost.
    """
    windows = len(digit) - wide + 1
    key = (digit & ~np.uint64(0xFFFFFF)) | np.arange(len(digit), dtype=np.uint64)
    padded = np.full(-(-len(key) // wide) * wide, ~np.uint64(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suffix[:windows], prefix[wide - 1 : wide - 1 + windows])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def window_runs(data: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, lo, hi, first digit, two halves of the hull's digest) of each run of windows.

    The run has the windows that start at anchor - hi ... anchor - lo; its hull is the
    bytes from anchor - hi to anchor - lo + depth.
    """
    wide = depth - gram + 1
    for base in range(0, len(data) - depth + 1, SEGMENT):
        part = data[base : base + SEGMENT + depth - 1]
        windows = len(part) - depth + 1
        hashes = Hashes(part)
        grams = np.arange(len(part) - gram + 1)
        digit = hashes.of(grams, grams + gram)
        anchors = _anchors(digit, wide)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        at = anchors[first]
        hull = digests(part.tobytes(), first, last + depth)
        yield at + base, at - last, at - first, digit[at].view(np.int64), hull[:, 0], hull[:, 1]


_RUN = ["a", "lo", "hi", "core", "hull1", "hull2"]
_RUN_SCHEMA = "k1 long, k2 long, a long, lo int, hi int, core long, hull1 long, hull2 long"


def _level0(batches: Iterator[pd.DataFrame], depth: int, gram: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, owner = [], []
        for i, text in enumerate(batch["text"]):
            data = np.frombuffer((text or "").encode(), np.uint8)
            if len(data) >= depth:
                for runs in window_runs(data, depth, gram):
                    found.append(runs)
                    owner.append(np.full(len(runs[0]), i))
        if found:
            at = np.concatenate(owner)
            columns = {n: np.concatenate([f[j] for f in found]) for j, n in enumerate(_RUN)}
            yield pd.DataFrame(
                {"k1": batch["k1"].to_numpy()[at], "k2": batch["k2"].to_numpy()[at], "a": columns["a"], "lo": columns["lo"].astype(np.int32), "hi": columns["hi"].astype(np.int32)}
                | {n: columns[n] for n in ("core", "hull1", "hull2")}
            )


def _children(batches: Iterator[pd.DataFrame], depth: int, width: int) -> Iterator[pd.DataFrame]:
    """Each run's parts by intervals of ``width`` offsets, with their shared bytes' and hulls' hashes."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("row", "lo", "hi", "core", "hull1", "hull2")}
        for i, (lo, hi, text) in enumerate(zip(batch["lo"], batch["hi"], batch["text"])):
            hashes = Hashes(np.frombuffer(text, np.uint8))
            c = np.arange(lo // width, hi // width + 1)
            low, high = np.maximum(c * width, lo), np.minimum(c * width + width - 1, hi)
            begin, end = hi - c * width, hi - (c * width + width - 1) + depth  # shared by all windows of the whole interval, so by any run in it
            out["row"].append(np.full(len(c), i))
            out["lo"].append(low)
            out["hi"].append(high)
            out["core"].append((hashes.of(begin, end) ^ mixed(c.astype(np.uint64))).view(np.int64))
            hull = digests(text, hi - high, hi - low + depth)
            out["hull1"].append(hull[:, 0])
            out["hull2"].append(hull[:, 1])
        if out["row"]:
            o = {n: np.concatenate(v) for n, v in out.items()}
            yield pd.DataFrame(
                {n: batch[n].to_numpy()[o["row"]] for n in ("k1", "k2", "a", "live")}
                | {n: o[n].astype(np.int32) for n in ("lo", "hi")}
                | {n: o[n] for n in ("core", "hull1", "hull2")}
            )


def _pass(stage: Stage, runs: DataFrame, name: str, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(repeated runs that are still asked for, runs that go to the next pass)."""
    shared = runs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    shared = stage.write(shared, f"{name}-cores")  # written, so that the join can split a hot group's rows
    runs = stage.write(runs.join(shared, "core", "left_semi"), f"{name}-shared")
    hull = ["lo", "hi", "hull1", "hull2"]
    groups = runs.groupBy(*hull).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "a")).alias("one"), F.min("core").alias("core"), F.max("live").alias("live")
    )
    repeated = stage.write(groups.where("n > 1").select(*hull), f"{name}-hulls")
    spans = stage.write(runs.where("live").join(repeated, hull, "left_semi").select("k1", "k2", (F.col("a") - F.col("hi")).alias("from"), (F.col("a") - F.col("lo")).alias("last")), f"{name}-spans")
    if last:
        return spans, None
    groups = groups.withColumn("live", F.col("live") & (F.col("n") == 1))
    open_ = groups.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("live").alias("live")).where("n > 1 AND live").select("core")
    open_ = stage.write(open_, f"{name}-open")
    rest = groups.join(open_, "core", "left_semi").select("one.*", "lo", "hi", "live")
    return spans, stage.write(rest, f"{name}-rest")


def _keyed(docs: DataFrame) -> DataFrame:
    """Two keys of a row's doc_id and text; rows with both the same are the same case."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, widths=WIDTHS) -> DataFrame:
    """(k1, k2, from, last): starts from ... last of windows that start elsewhere too."""
    stage = Stage(docs.sparkSession, "repeats")
    keyed = _keyed(docs).select("k1", "k2", "text")
    runs = stage.write(keyed.where(F.octet_length("text") >= depth).mapInPandas(lambda b: _level0(b, depth, gram), _RUN_SCHEMA), "runs").withColumn("live", F.lit(True))
    spans, rest = _pass(stage, runs, "pass0", False)
    asked = rest.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "lo", "hi", "live")).alias("runs"))
    text = F.encode("text", "UTF-8")
    nodes = (
        keyed.join(asked, ["k1", "k2"])
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", text.alias("bytes"), F.explode("runs").alias("r"))
        .select("k1", "k2", "r.*", F.expr("substring(bytes, cast(r.a - r.hi + 1 AS int), r.hi - r.lo + %d)" % depth).alias("text"))
    )
    nodes, kept = stage.write(nodes, "nodes0"), ["pass0-spans"]
    stage.only("nodes0", *kept)
    for i, width in enumerate(widths, 1):
        parts = nodes.mapInPandas(lambda b, w=width: _children(b, depth, w), _RUN_SCHEMA + ", live boolean")
        found, rest = _pass(stage, parts, f"pass{i}", i == len(widths))
        spans = spans.unionByName(found)
        kept.append(f"pass{i}-spans")
        if rest is not None:
            n, r = nodes.alias("n"), rest.alias("r")
            same = [F.col(f"n.{k}") == F.col(f"r.{k}") for k in ("k1", "k2", "a")] + [F.col("n.lo") <= F.col("r.lo"), F.col("r.hi") <= F.col("n.hi")]
            nodes = stage.write(
                n.join(r, same).select("r.*", F.expr("substring(n.text, n.hi - r.hi + 1, r.hi - r.lo + %d)" % depth).alias("text")).dropDuplicates(["k1", "k2", "a", "lo", "hi"]),
                f"nodes{i}",
            )
        stage.only(f"nodes{i}", *kept)
    return spans


def word_runs(pieces: list[list[bytes]], size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, lo, hi, first digit, two halves of the hull's digest) of each run of word windows.

    Each piece has ``size`` words at least; places are counted in its words. White space
    between words is one space in the digests.
    """
    joined = b"".join([b" ".join(words) + b" " for words in pieces])
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 0x20)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.array([len(words) for words in pieces])
    first_word = np.cumsum(counts) - counts
    bounds = np.concatenate([starts[first_word], [len(data)]])
    digit = window_hashes(word_hashes(data, bounds)[0], gram)
    owner = np.repeat(np.arange(len(pieces)), counts)
    inside = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :])
    anchors = _anchors(digit, size - gram + 1)[inside]
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    first, last = inside[np.concatenate([[0], change])], inside[np.concatenate([change - 1, [len(inside) - 1]])]
    at = anchors[np.concatenate([[0], change])]
    hull = digests(joined, starts[first], ends[last + size - 1])
    return owner[first], at - first_word[owner[first]], at - last, at - first, digit[at].view(np.int64), hull[:, 0], hull[:, 1]


def _word_level0(batches: Iterator[pd.DataFrame], size: int, gram: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        pieces, rows, bases, n = [], [], [], 0
        for i, text in enumerate(batch["text"]):
            words = text.encode().split()  # at ASCII white space
            for base in range(0, len(words) - size + 1, WORD_SEGMENT):
                pieces.append(words[base : base + WORD_SEGMENT + size - 1])
                rows.append(i)
                bases.append(base)
                n += len(pieces[-1])
                if n >= WORD_SEGMENT:
                    yield _word_frame(k1, k2, pieces, rows, bases, size, gram)
                    pieces, rows, bases, n = [], [], [], 0
        if pieces:
            yield _word_frame(k1, k2, pieces, rows, bases, size, gram)


def _word_frame(k1, k2, pieces, rows, bases, size, gram) -> pd.DataFrame:
    owner, a, lo, hi, core, hull1, hull2 = word_runs(pieces, size, gram)
    row = np.array(rows)[owner]
    return pd.DataFrame({"k1": k1[row], "k2": k2[row], "a": a + np.array(bases)[owner], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "core": core, "hull1": hull1, "hull2": hull2})


def _word_windows(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The digest of each window of the runs asked for."""
    for batch in batches:
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        rows, hulls, n = [], [], 0
        for i, (text, runs) in enumerate(zip(batch["text"], batch["runs"])):
            joined = b" ".join(text.encode().split()) + b" "
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
            starts = np.concatenate([[0], ends[:-1] + 1])
            at = np.concatenate([np.arange(r["a"] - r["hi"], r["a"] - r["lo"] + 1) for r in runs])
            hulls.append(digests(joined, starts[at], ends[at + size - 1]))
            rows.append(np.full(len(at), i))
            n += len(at)
            if n >= WORD_SEGMENT or i == len(batch) - 1:
                row, hull = np.concatenate(rows), np.concatenate(hulls)
                yield pd.DataFrame({"k1": k1[row], "k2": k2[row], "hull1": hull[:, 0], "hull2": hull[:, 1]})
                rows, hulls, n = [], [], 0


def _by_documents(rows: DataFrame, *by: str, **more) -> DataFrame:
    """Groups, with ``many``: more than one document has rows in it."""
    ends = [f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]
    return rows.groupBy(*by).agg(*ends, *(v.alias(k) for k, v in more.items())).withColumn("many", F.expr("min_k1 <> max_k1 OR min_k2 <> max_k2")).select(*by, *more, "many")


def shared_passages(docs: DataFrame, size: int = PASSAGE, gram: int = WORD_GRAM) -> DataFrame:
    """(k1, k2) of the documents with ``size`` words in a row that another document has too.

    A document whose run of windows is shared as a whole is settled. The others' runs that
    share an anchor with another document are compared window by window, with one
    representative of each different run at that anchor.
    """
    stage = Stage(docs.sparkSession, "passages")
    keyed = _keyed(docs).select("k1", "k2", "text")
    runs = stage.write(keyed.where(F.octet_length("text") >= 2 * size - 1).mapInPandas(lambda b: _word_level0(b, size, gram), _RUN_SCHEMA), "runs")
    cores = stage.write(_by_documents(runs, "core").where("many").select("core"), "cores")
    shared = stage.write(runs.join(cores, "core", "left_semi"), "shared")
    stage.only("shared")
    groups = stage.write(_by_documents(shared, "hull1", "hull2", core=F.min("core"), one=F.min(F.struct("k1", "k2", "a", "lo", "hi"))), "groups")
    whole = stage.write(shared.join(groups.where("many"), ["hull1", "hull2"], "left_semi").select("k1", "k2").distinct(), "whole")
    open_ = stage.write(shared.join(whole, ["k1", "k2"], "left_anti").select("core").distinct(), "open")
    asked = groups.join(open_, "core", "left_semi").select("one.*").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("runs"))
    windows = stage.write(keyed.join(asked, ["k1", "k2"]).mapInPandas(lambda b: _word_windows(b, size), "k1 long, k2 long, hull1 long, hull2 long"), "windows")
    again = stage.write(_by_documents(windows, "hull1", "hull2").where("many").select("hull1", "hull2"), "again")
    parts = stage.write(windows.join(again, ["hull1", "hull2"], "left_semi").select("k1", "k2").distinct(), "parts")
    stage.only("whole", "parts")
    return whole.union(parts).distinct()


def _cut(batches: Iterator[pa.RecordBatch], depth: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *([pa.binary(), pa.list_(pa.list_(pa.int64()))] if with_text else [])]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_chars", *(["kept", "spans"] if with_text else [])]
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = (text.as_py() or "").encode()
            kept, at, removed, runs = [], 0, 0, []
            for begin, end in sorted((s["from"], s["last"] + depth) for s in (spans.as_py() or ())):
                if runs and begin <= runs[-1][1]:
                    runs[-1][1] = max(end, runs[-1][1])
                else:
                    runs.append([begin, end])
            for begin, end in runs:
                kept.append(data[at:begin])
                removed, at = removed + end - begin, end
            left = b"".join([*kept, data[at:]])
            rows.append((len(data), removed, len(runs), hashlib.sha256(left).hexdigest(), len(left.decode(errors="ignore")), *([left, runs] if with_text else [])))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("shared").fill_null(False)], names=["doc_id", *names, "shared_passage"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, widths=WIDTHS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_chars, shared_passage.

    kept_chars counts the whole characters that remain. shared_passage: over 50 words in a
    row are in another document too, be they shorter than ``depth`` bytes and so left or not.
    ``with_text`` adds kept (the bytes that remain) and spans (the removed [from, to)).
    A null text is empty. Repeated rows count as two places, so both lose what they share.
    Texts under ``depth`` bytes keep all. Removal is by bytes: what is kept need not be
    valid UTF-8 if a window ended inside a character.
    """
    found = repeated_spans(docs, depth, gram, widths).select("k1", "k2", F.struct("from", "last").alias("span"), F.lit(False).alias("shared"))
    marks = shared_passages(docs).select("k1", "k2", F.lit(None).cast(found.schema["span"].dataType).alias("span"), F.lit(True).alias("shared"))
    found = found.union(marks).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"), F.max("shared").alias("shared"))
    joined = _keyed(docs).select("doc_id", "text", "k1", "k2").join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans", "shared")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_chars long" + ", kept binary, spans array<array<long>>" * with_text + ", shared_passage boolean"
    return joined.mapInArrow(lambda b: _cut(b, depth, with_text), schema)
