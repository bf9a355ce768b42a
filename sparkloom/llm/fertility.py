"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback is a measure of how much a text looks like
language: words it knows take few tokens, junk takes many or falls back to bytes, and a
text that says one thing over and over has little token entropy. Measured per document:
characters per token, tokens per word, share of byte tokens, and the entropy of its
tokens as a share of the most that so many tokens can have.

Every group (the document's language, or its script where none is given) has rejection
bands from all of its documents that pass the base rules: the quartiles widened by
``FENCE`` times their distance. Short texts scatter more, so their bands are wider.
A group of n documents has bands at every size: its quartiles count n / (n + ``SHRINK``), those
of all documents in the row's script the rest. The bands are widened by the distance that this
moves the median, so that a rare language is not judged by the common ones alone. Fixed limits
hold for all groups besides.

The base rules (words, symbols, repeated lines and 8-word windows) come from the same
pass over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .common import ASCII_SPACE, grid_quantiles
from .hashing import window_hashes, word_hashes
from .packing import WordTokenizer

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
FENCE = 3.0
SHRINK = 20
#: Quartiles are of measures in steps of 1 / GRID.
GRID = 1000
#: Bands are meant for texts of this many words; shorter ones get wider bands.
USUAL_WORDS = 200
#: (measure, lowest, highest) that any group may have, and the least half-width as a share of the median.
FIXED = (("chars_per_token", 1.0, 12.0), ("tokens_per_word", 1.0, 12.0), ("byte_share", None, 0.3), ("entropy_share", 0.3, None))
LEAST_WIDTH = 0.1
#: Code point ranges by script, first match wins.
SCRIPTS = (
    ("han", "[\u4e00-\u9fff]"), ("kana", "[\u3040-\u30ff]"), ("hangul", "[\uac00-\ud7af]"), ("cyrillic", "[\u0400-\u052f]"), ("greek", "[\u0370-\u03ff]"),
    ("arabic", "[\u0600-\u06ff]"), ("hebrew", "[\u0590-\u05ff]"), ("devanagari", "[\u0900-\u097f]"), ("thai", "[\u0e00-\u0e7f]"),
)
_SCRIPTS = [(name, re.compile(pattern)) for name, pattern in SCRIPTS]


class PieceTokenizer(WordTokenizer):
    """The same word cache over a SentencePiece model; words never share a token."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._clear()

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        return self.model.encode([w.decode() for w in words], num_threads=1)


_TOKENIZERS: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PieceTokenizer(path)
    return _TOKENIZERS[path]


def script(text: str) -> str:
    """The script that most of the text's letters beyond Latin are in; latin if those are few."""
    if text.isascii():
        return "latin"
    counts = [(len(p.findall(text)), name) for name, p in _SCRIPTS]
    most, name = max(counts)
    return name if 4 * most > len(text) else "latin"


def repeated_words(data: np.ndarray, window: int = WINDOW) -> int:
    """Words inside word windows that the text has twice or more, the first time included."""
    words, _ = word_hashes(data, np.array([0, len(data)]))
    if len(words) <= window:
        return 0
    total = window_hashes(words, window)
    _, at, counts = np.unique(total, return_inverse=True, return_counts=True)
    mark = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(counts[at] > 1)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + window, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def measure(text: str | None, tokenizer: PieceTokenizer) -> tuple:
    """The base counts and the fertility measures of one whole text; a null text is empty."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            repeated_lines += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    ids = tokenizer.encode_words(words)
    tokens = len(ids)
    shares = np.bincount(ids)[np.unique(ids)] / max(tokens, 1) if tokens else np.ones(1)
    entropy = float(-(shares * np.log2(shares)).sum())
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines, repeated_words(np.frombuffer(data, np.uint8)), script(text),
        chars / max(tokens, 1), tokens / max(len(words), 1), float(tokenizer.is_byte[ids].mean()) if tokens else 0.0,
        entropy / np.log2(tokens) if tokens > 1 else 1.0,
    )


MEASURES = tuple(name for name, _, _ in FIXED)
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES)


def measured(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    types = [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * len(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for b in batches:
            rows = [measure(t.as_py(), tokenizer) for t in b.column("text")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *columns], names=["doc_id", "lang", *_COLUMNS])

    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    return docs.select("doc_id", "lang", "text").mapInArrow(run, kinds + ", ".join(f"{m} double" for m in MEASURES))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def bands(rows: DataFrame, by: str = "group") -> DataFrame:
    """(by, by_n, by_m_low, by_m_mid, by_m_high for each measure m): quartiles, down to 1 / ``GRID``, of the rows that pass the base rules."""
    found = grid_quantiles(rows.where("NOT base_failed"), by, {m: F.floor(F.col(m) * GRID) for m in MEASURES}, (0.25, 0.5, 0.75))
    return found.select(by, F.col("n").alias(f"{by}_n"), *((F.col(f"{m}_{i}") / GRID).alias(f"{by}_{m}_{n}") for m in MEASURES for i, n in enumerate(("low", "mid", "high"))))


def quality_rules(docs: DataFrame, tokenizer_path: str, fence: float = FENCE, shrink: float = SHRINK) -> DataFrame:
    """One row per row of ``docs``: the base counts, the measures, base_failed and kept.

    ``docs`` has doc_id, text and lang; a null lang groups by script, a null or empty text
    has no words and fails the base rules. Repeated rows are judged one by one.
    """
    stage = Stage(docs.sparkSession, "fertility")
    rows = stage.write(measured(docs, tokenizer_path), "measured")
    rows = rows.withColumn("group", F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    judged = rows.join(stage.write(bands(rows), "bands"), "group", "left")  # one row a group; adaptive execution broadcasts it when it is small
    judged = judged.join(stage.write(bands(rows, "script"), "scripts"), "script", "left")  # one row a script
    wide = F.sqrt(F.greatest(F.lit(1.0), USUAL_WORDS / F.greatest(F.col("n_words"), F.lit(1))))
    own = F.col("group_n") / (F.col("group_n") + shrink)
    inside = F.lit(True)
    for m, lowest, highest in FIXED:
        low, mid, high = (own * F.col(f"group_{m}_{n}") + (1 - own) * F.col(f"script_{m}_{n}") for n in ("low", "mid", "high"))
        half = F.greatest(fence * (high - low), LEAST_WIDTH * F.abs(mid)) * wide + F.abs(F.col(f"group_{m}_mid") - mid)
        if lowest is not None:
            inside = inside & (F.col(m) >= lowest) & (F.col(m) >= low - half)
        if highest is not None:
            # Byte tokens are rare in most languages; a few never reject a text.
            inside = inside & (F.col(m) <= highest) & (F.col(m) <= high + half + (0.02 if m == "byte_share" else 0.0))
    return judged.select("doc_id", *_COLUMNS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "group", *MEASURES)
