"""Prefix-code lengths and checksums as mergeable aggregates.

Checksums: a stream is cut into blocks anywhere, and each block is summed up alone. Both
sums are additions once it is known how many bytes come after a block: CRC-32 is linear
over GF(2), so a block's CRC times x^(8 * bytes after it) is its share, and shares are
combined by exclusive or; Adler-32's second sum takes a block's first sum once for every
byte after it. The shares come in any order, so one partial and one final aggregate do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .edges import scan

#: The polynomial of CRC-32 with its lowest power first, and Adler-32's modulus.
CRC_POLYNOMIAL = 0xEDB88320
ADLER_MODULUS = 65521
MOST_BITS = 15


def limited_lengths(counts: list[int], most: int = MOST_BITS) -> list[int]:
    """Optimal prefix-code lengths of at most ``most`` bits for the symbols of ``counts``, by package-merge.

    Symbols that don't occur get length 0. A code needs two symbols: with fewer, the first ones get one bit.
    """
    used = sorted((c, s) for s, c in enumerate(counts) if c > 0)
    out = [0] * len(counts)
    if len(used) < 2:
        for s in {s for _, s in used} or {0}:
            out[s] = out[s + 1 if s + 1 < len(out) else s - 1] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols need more than {most} bits")
    coins = [(c, (s,)) for c, s in used]
    row: list = []
    for _ in range(most):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted([*coins, *pairs], key=lambda coin: coin[0])
    for _, symbols in row[: 2 * len(used) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def canonical_codes(lengths: list[int]) -> list[int | None]:
    """The code of each symbol, in the order of (length, symbol); None for those without."""
    code, last, out = 0, 0, [None] * len(lengths)
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s], last, code = code, n, code + 1
    return out


def code_lengths(histogram: DataFrame, by: tuple[str, ...], symbols: int, most: int = MOST_BITS) -> DataFrame:
    """(by ..., symbol, length, code) for each group of a histogram (by ..., bucket, n); symbols without a code are left out.

    The counts of a group, ``symbols`` of them at most, go to one task; null or missing counts are 0.
    Equal counts are taken by symbol, so the result doesn't depend on the order of rows.
    """
    kinds = dict(histogram.dtypes)
    keys = list(by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(symbols, np.int64)
        counts[group["bucket"].to_numpy(np.int64)] = group["n"].fillna(0).to_numpy(np.int64)
        lengths = limited_lengths(counts.tolist(), most)
        codes = canonical_codes(lengths)
        found = [s for s in range(symbols) if lengths[s]]
        out = pd.DataFrame({"symbol": found, "length": [lengths[s] for s in found], "code": [codes[s] for s in found]})
        for i, k in enumerate(keys):
            out.insert(i, k, [group[k].iloc[0]] * len(out))
        return out

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "symbol int, length int, code long"])
    return histogram.where(F.col("bucket").between(0, symbols - 1)).select(*keys, "bucket", "n").groupBy(*keys).applyInPandas(run, schema)


def code_summary(histogram: DataFrame, codes: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by ..., n_symbols, longest, kraft, total_bits): kraft is the sum of 2^(15 - length), 2^15 for a full code."""
    counts = histogram.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("bucket").alias("symbol"), "n")
    same = F.col("symbol") == F.col("_symbol")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = codes.withColumnRenamed("symbol", "_symbol").join(counts, same)
    kraft = F.sum(F.expr(f"shiftleft(1, {MOST_BITS} - length)"))
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n_symbols"), F.max("length").alias("longest"), kraft.cast("long").alias("kraft"), F.sum(F.col("n") * F.col("length")).cast("long").alias("total_bits"))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """Products with the polynomial ``b``, modulo CRC-32's; bit 31 is the power 0."""
    out, a = np.zeros_like(a), a.copy()
    for bit in range(31, -1, -1):
        if b >> bit & 1:
            out ^= a
        a = (a >> np.uint32(1)) ^ (np.uint32(CRC_POLYNOMIAL) * (a & np.uint32(1)))
    return out


def crc_shift(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """CRCs times x^(8 * after): what they add to a stream with ``after`` bytes behind them."""
    out, rest, power = crc.astype(np.uint32), after.astype(np.int64).copy(), 1 << (31 - 8)
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _times(out[odd], power)
        power, rest = int(_times(np.array([power], np.uint32), power)[0]), rest >> 1
    return out


def stream_checksums(blocks: DataFrame, stream: str = "stream", seq: str = "seq", content: str = "block") -> DataFrame:
    """(stream, n_bytes, crc32, adler32) of streams whose binary blocks stand in the order of ``seq``.

    Null blocks are empty, blocks with equal seq are in any order; a null stream is a stream.
    Offsets are prefix sums over range partitions, so one stream may hold most of the rows.
    """
    kind = dict(blocks.dtypes)[stream]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b or b"" for b in batch.column("block").to_pylist()]
            adler = np.array([zlib.adler32(b) for b in data], np.int64)
            size = np.array([len(b) for b in data], np.int64)
            first = (adler % 65536 - 1) % ADLER_MODULUS
            second = (adler // 65536 - size) % ADLER_MODULUS
            columns = [pa.array(size), pa.array(np.array([zlib.crc32(b) for b in data], np.int64)), pa.array(first), pa.array(second)]
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("seq"), *columns], names=["stream", "seq", "size", "crc", "first", "second"])

    rows = blocks.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), F.col(content).alias("block"))
    stage = Stage(blocks.sparkSession, "checksums")
    each = stage.write(rows.mapInArrow(run, f"stream {kind}, seq {dict(blocks.dtypes)[seq]}, size long, crc long, first long, second long"), "blocks")
    placed = stage.write(scan(each, F.col("size"), ("stream", "seq"), name="end"), "placed")
    whole = stage.write(placed.groupBy("stream").agg(F.max("end").alias("last")).withColumnRenamed("stream", "_stream"), "ends")
    after = placed.join(whole, F.col("stream").eqNullSafe(F.col("_stream"))).select("stream", "size", "crc", "first", "second", (F.col("last") - F.col("end")).alias("after"))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = crc_shift(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
            yield batch.set_column(2, "crc", pa.array(moved.astype(np.int64)))

    # A CRC starts and ends with all bits inverted; the inversions of neighbours cancel out.
    shares = after.select("stream", "size", "crc", "first", "second", "after").mapInArrow(shift, f"stream {kind}, size long, crc long, first long, second long, after long")
    second = (F.col("second") + F.col("first") * (F.col("after") % ADLER_MODULUS)) % ADLER_MODULUS
    sums = shares.groupBy("stream").agg(F.sum("size").alias("n_bytes"), F.bit_xor("crc").alias("crc32"), F.sum("first").alias("a"), F.sum(second).alias("b"))
    a, b = (F.col("a") + 1) % ADLER_MODULUS, (F.col("b") + F.col("n_bytes")) % ADLER_MODULUS
    return sums.select(F.col("stream").alias(stream), "n_bytes", "crc32", (b * 65536 + a).alias("adler32"))
