"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated.

Features of a whole text: densities of a lexicon's hits (weighted and not), how often a
hit stands near a second-person word, capitals, punctuation and obfuscation rates. The
lexicon (words, and word beginnings for inflected forms) is learned from labelled rows by
log odds. Labels come only from rows outside the held-out fold; language, source, id and
labels are never features.

Fitting uses at most ``MAX_LABELLED`` labelled rows (lowest hash of the id first), so what
reaches the driver, and the model that is sent out (the lexicon is made of those rows'
words), have bounds that don't grow with the documents. To keep the trees
from trusting a lexicon that has seen their rows, the fitting rows' features come from the
lexicons of the other folds; calibration uses the trees of the other folds likewise.
Scoring is one pass over the documents without any shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage

MAX_LABELLED = 20_000
FOLDS = 3
THRESHOLD = 0.3
#: Documents are held out if crc32 of the id's digits leaves this remainder modulo HELD_OUT[1].
HELD_OUT = (2, 4)
STEMS = (4, 5)
NEAR = 5
#: Second-person words.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tus tuyo vosotros".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_][0-9@$!*+]+[^\W\d_]|\b(?:[^\W\d_][ .\-_]){3,}[^\W\d_]\b|([^\W\d_])\1{3,}")
FEATURES = (
    "log_words", "hits", "hit_rate", "weight_rate", "weight_max", "weight_sum", "kinds", "near_you", "near_rate", "you_rate",
    "capital_rate", "capital_words", "exclaim_rate", "question_rate", "mark_rate", "obfuscated_rate", "digit_rate", "mean_word",
)


def units(words: list[str]) -> set[str]:
    """A text's distinct words and word beginnings ("^" in front)."""
    seen = set(words)
    return seen.union(*({f"^{w[:n]}" for w in seen if len(w) > n} for n in STEMS))


class Lexicon(dict):
    """Weight of any word: the largest of the word's own and its beginnings' weights, else 0."""

    LIMIT = 500_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        w = max(self.weights.get(word, 0.0), *(self.weights.get(f"^{word[:n]}", 0.0) for n in STEMS if len(word) > n), 0.0)
        if len(self) < self.LIMIT:
            self[word] = w
        return w


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = LETTERS.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    weights = [lexicon[w] for w in words]
    at = [i for i, w in enumerate(weights) if w]
    hits = [weights[i] for i in at]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if at and you:
        spots = np.array(you)
        right = np.searchsorted(spots, at)
        gaps = np.minimum(np.abs(spots[np.minimum(right, len(spots) - 1)] - at), np.abs(spots[np.maximum(right - 1, 0)] - at))
        near = int((gaps <= NEAR).sum())
    letters = sum(map(len, words))
    capitals = sum(1 for c in text if c.isupper())
    return [
        np.log1p(len(words)), float(len(hits)), len(hits) / n, sum(hits) / n, max(hits, default=0.0), sum(hits), float(len({words[i] for i in at})),
        float(near), near / n, len(you) / n, capitals / max(letters, 1), sum(map(str.isupper, text.split())) / n,
        text.count("!") / chars, text.count("?") / chars, (chars - letters - text.count(" ")) / chars,
        sum(1 for _ in OBFUSCATED.finditer(text)) / n, sum(map(str.isdigit, text)) / chars, letters / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logistic loss; nodes in heap order."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.15
    bins: int = 48
    ridge: float = 1.0
    base: float = 0.0
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    leaf: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
            node = np.zeros(len(y), int)
            for level in range(self.depth):
                lo, n = 2**level - 1, 2**level
                gain_best = np.full(n, 1e-6)
                g_all, h_all = (np.bincount(node - lo, v, n) for v in (grad, hess))
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = len(e) + 1
                    cell = (node - lo) * k + binned[j]
                    g, h = (np.cumsum(np.bincount(cell, v, n * k).reshape(n, k), axis=1)[:, :-1] for v in (grad, hess))
                    gr, hr = g_all[:, None] - g, h_all[:, None] - h
                    gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
                    gain[(h < 0.5) | (hr < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(n), at] > gain_best):
                        gain_best[i], feature[lo + i], cut[lo + i] = gain[i, at[i]], j, e[at[i]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
            leaf = self.rate * g / (h + self.ridge)
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(leaf)
            score += leaf[node - inner]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score, inner = np.full(len(x), self.base), 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - inner]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best rising fit."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v2, n2, _, top = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = top
    knots = [(s, v / n) for v, n, low, high in pools for s in ((low, high) if high > low else (low,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        raw = self.trees.raw(x)
        # A sliver of the raw score keeps the order inside the flat parts of the fit.
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT[1] == HELD_OUT[0], F.lit(False))


def _fold(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``max_labelled`` of them.

    Labels that are null, or of ids that ``docs`` lacks, are passed over. Without both
    kinds of labels every score is 0.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    stage = Stage(spark, "toxicity")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", _fold("doc_id").alias("fold"))  # at most max_labelled rows of 12 bytes
    rows = stage.write(rows, "labelled")  # read by every step below; the documents only here

    def counts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = Counter((y, f, u) for y, f, t in zip(b["y"], b["fold"], b["text"]) for u in units(LETTERS.findall((t or "").lower())))
            yield pd.DataFrame([(y, f, u, n) for (y, f, u), n in counts.items()], columns=["y", "fold", "unit", "n"])

    sizes = {(r["y"], r["fold"]): r["n"] for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}{k}") for y in (1, 0) for k in range(FOLDS)]
    counted = rows.where("y IN (0, 1)").mapInPandas(counts_of, "y int, fold int, unit string, n long").groupBy("unit").agg(*each)
    counted = stage.write(counted.where(" + ".join(f"n1{k}" for k in range(FOLDS)) + " >= 3"), "units")

    def lexicon(without: int | None) -> dict[str, float]:
        """The units that stand out clearly in at least 3 toxic rows (or 0.4 % of them); as many at most as the labelled rows hold."""
        folds = [k for k in range(FOLDS) if k != without]
        (a, n_a), (b, n_b) = ((sum((F.col(f"n{y}{k}") for k in folds), F.lit(0)), sum(sizes.get((y, k), 0) for k in folds)) for y in (1, 0))
        weight = F.log((a + 0.5) / (n_a + 1)) - F.log((b + 0.5) / (n_b + 1))
        found = counted.select("unit", a.alias("a"), b.alias("b"), weight.alias("w")).where((F.col("a") >= max(3, n_a * 0.004)) & (F.col("w") > 1.5))
        clear = found.where("w - 1.64 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 0.3")
        return {r["unit"]: r["w"] for r in clear.collect()}

    folds = [lexicon(k) for k in range(FOLDS)]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons = [Lexicon(w) for w in folds]
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "fold": b["fold"], "x": [features(t, lexicons[f]) for t, f in zip(b["text"], b["fold"])]})

    fitted = rows.mapInPandas(measured, "y int, fold int, x array<double>").toPandas()  # at most max_labelled rows
    y = fitted["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model({}, None, None)
    x, fold = np.array(fitted["x"].tolist()), fitted["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # whatever order the rows came in
    x, y, fold = x[order], y[order], fold[order]
    outside = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and not rest.all():
            outside[~rest] = Trees().fit(x[rest], y[rest]).raw(x[~rest])
    return Model(lexicon(None), Trees().fit(x, y), isotonic(outside, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null or empty text gets the score of no features.

    Equal texts get equal scores, and repeated rows a result each; a null doc_id is not held out.
    A text of any length is read whole, in time linear in it and within one task. A score
    of exactly ``threshold`` is predicted toxic. Other columns are not read, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of trees, words of the labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value.lexicon)
        for b in batches:
            x = np.array([features(t.as_py(), lexicon) for t in b.column("text")]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(sent.value.score(x))], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, unchanged and without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(sent.value.lexicon)
        for t in texts:
            yield pd.Series(sent.value.score(np.array([features(s, lexicon) for s in t]).reshape(len(t), len(FEATURES))))

    return docs.where(toxicity(docs["text"]) < threshold)
