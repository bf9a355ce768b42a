"""Hashes of words and byte strings, vectorised over a whole text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Places of a word whose values are kept in a table.
_PLACES = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _value(code: np.ndarray) -> np.ndarray:
    """An unrelated 64-bit value for each (place, byte)."""
    return mixed(mixed(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0xC2B2AE3D27D4EB4F))


_TABLE = _value(np.arange(_PLACES << 8))


def text_bytes(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of texts in a row, about ``most`` bytes at once or one longer text; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, places, content = texts.buffers()
    bounds = np.frombuffer(places, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data, at = np.frombuffer(content if content is not None else b"", np.uint8), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a hash of each word of several texts, and each text's first word.

    A word's hash is the sum of values drawn for its bytes by place. Every place has values
    of its own, so no pattern of bytes makes two words alike, as it does for polynomials
    modulo a power of two.
    """
    space = SPACE[data]
    after, before = np.ones(len(data), bool), np.ones(len(data), bool)  # white space, or a text's edge, beside a byte
    after[1:], before[:-1] = space[:-1], space[1:]
    after[bounds[:-1][bounds[:-1] < len(data)]] = True
    before[bounds[1:][bounds[1:] > 0] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & after), np.flatnonzero(word & before) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    code = (np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)) << 8
    code += data[word]
    values = _TABLE[code] if lengths.max() <= _PLACES else _value(code)
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0x165667B19E3779F9)), np.searchsorted(starts, bounds)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, in order: unrelated odd multiples of them, summed and mixed."""
    n, factors = len(words) - size + 1, mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.full(n, np.uint64(size * 0x9E37), np.uint64)
    for i in range(size):
        total += words[i : n + i] * factors[i]
    return mixed(total)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2b-128 of substrings, two signed integers a row: strings of one digest are the same."""
    make = hashlib.blake2b
    joined = b"".join([make(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(joined, np.int64).reshape(-1, 2)
