"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are over UTF-8 bytes, so no script is out of vocabulary and a key of up to
seven bytes is one exact integer: a 1 bit, then the bytes.

* Training counts the highest order in all trusted documents (those labelled of good
  quality) and derives the lower orders' continuation counts, contexts, discounts and
  interpolated probabilities by grouped aggregation and joins on the key; the model is a
  table sharded by key and grows with the trusted text.
* Scoring packs documents into chunks, written once in buckets. A chunk asks for its
  distinct n-grams once; the requests are joined with the model, and the answers go to the
  chunk's bucket, so the join moves distinct n-grams of chunks, and no text is shuffled.
* Trusted documents are split by a hash of their id: one part in ``HELD_OUT`` is never
  trained on, and per language a quantile of its perplexity is the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.staging import Stage, release

from .common import grid_quantiles
from .jaccard import FILTER_BITS, _bit, _filter_words

ORDER = 5
QUANTILE = 0.995
HELD_OUT = 5
#: Thresholds are taken up to the next step of 1 / GRID in the log of the perplexity.
GRID = 10_000
SHRINK = 50
CHUNK_BYTES = 32 << 20
CHUNK_LEVEL = 6
#: N-grams are made and counted by pieces of this many bytes.
PIECE = 1 << 20
#: Stands before a text, so that its first bytes have contexts.
PAD = b"\n"


def grams(data: bytes, order: int) -> np.ndarray:
    """The key of the ``order``-gram that ends at each byte of a text."""
    padded = np.frombuffer(PAD * (order - 1) + data, np.uint8).astype(np.int64)
    keys = np.ones(len(data), np.int64)
    for i in range(order):
        keys = (keys << 8) | padded[i : i + len(data)]
    return keys


def shorter(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each key, as a key."""
    return (keys & ((1 << 8 * length) - 1)) | (1 << 8 * length)


def _pieces(texts: Iterator[bytes], order: int) -> Iterator[np.ndarray]:
    held, size = [], 0
    for t in texts:
        for at in range(0, len(t), PIECE):
            lead = t[max(0, at - order + 1) : at]
            keys = grams(lead + t[at : at + PIECE], order)[len(lead) :]
            held.append(keys)
            size += len(keys)
            if size > PIECE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _counted(batches: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in _pieces((t.encode() for b in batches for t in b["text"]), order):
        k, c = np.unique(piece, return_counts=True)
        both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, c]), len(both)).astype(np.int64)
        keys = both
        if len(keys) > 4 * PIECE:
            yield pd.DataFrame({"key": keys, "c": counts})
            keys, counts = keys[:0], counts[:0]
    yield pd.DataFrame({"key": keys, "c": counts})


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many counts are 1 to 4.

    An estimate that is not positive gives way to the plain absolute discount, so that every
    context leaves some weight to the shorter n-gram and no byte has probability 0.
    """
    n = counts.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    estimates = ((i, i - (i + 1) * y * (b / a if a else 0.0)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return [min(d if d > 0 else y, float(i)) for i, d in estimates]


def train(texts: DataFrame, order: int = ORDER, stage: Stage | None = None) -> DataFrame:
    """(key, p, g): interpolated probability of a seen n-gram, and the weight that its context leaves to the shorter one.

    ``texts`` has a text column; null and empty texts add nothing. Both columns can be null:
    a key may only be known as an n-gram or as a context.
    """
    stage = stage or Stage(texts.sparkSession, "kneser-ney")
    counts = texts.where("length(text) > 0").select("text").mapInPandas(lambda b: _counted(b, order), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    by_order = {order: stage.write(counts, f"c{order}")}
    for k in range(order - 1, 0, -1):
        tail = F.col("key").bitwiseAND((1 << 8 * k) - 1) + (1 << 8 * k)
        by_order[k] = stage.write(by_order[k + 1].groupBy(tail.alias("key")).agg(F.count(F.lit(1)).alias("c")), f"c{k}")
    below, model = None, None
    for k in range(1, order + 1):
        d = _discounts(by_order[k])
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        seen = by_order[k].withColumn("context", F.shiftright("key", 8))
        contexts = seen.groupBy("context").agg(F.sum("c").alias("all"), F.sum(discount).alias("left"))
        contexts = stage.write(contexts.select("context", "all", (F.col("left") / F.col("all")).alias("g")), f"contexts{k}")
        seen = seen.join(contexts, "context")
        own = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("all")
        if below is None:
            seen = seen.select("key", (own + F.col("g") / 256).alias("p"))
        else:
            tail = F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1) + (1 << 8 * (k - 1))
            seen = seen.withColumn("tail", tail).join(below.select(F.col("key").alias("tail"), F.col("p").alias("q")), "tail").select("key", (own + F.col("g") * F.col("q")).alias("p"))
        below = stage.write(seen, f"p{k}")
        rows = below.select("key", "p", F.lit(None).cast("double").alias("g")).unionByName(contexts.select(F.col("context").alias("key"), F.lit(None).cast("double").alias("p"), "g"))
        model = rows if model is None else model.unionByName(rows)
    model = model.unionByName(texts.sparkSession.range(1).selectExpr("1L AS key", "CAST(NULL AS double) AS p", "CAST(NULL AS double) AS g"))  # every chunk gets an answer
    out = stage.write(model.groupBy("key").agg(F.max("p").alias("p"), F.max("g").alias("g")), "model")
    stage.only("model")
    return out


def _packed(chunk: int, ids: list[pa.Array], langs: list[pa.Array], parts: list[bytes]) -> pa.RecordBatch:
    ids_, langs_ = pa.concat_arrays(ids), pa.concat_arrays(langs)
    known = ids_.is_valid().to_numpy(zero_copy_only=False)
    columns = {
        "chunk": pa.array([chunk], pa.int64()), "ids": pa.array([ids_.fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary()),
        "langs": pa.array([langs_.to_pylist()], pa.list_(pa.string())), "ends": pa.array([np.cumsum([len(p) for p in parts])], pa.list_(pa.int64())),
        "texts": pa.array([zstandard.compress(b"".join(parts), CHUNK_LEVEL)], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """One task's documents in order, cut at about ``chunk_bytes``."""
    chunk, ids, langs, parts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
    for b in batches:
        begin = 0
        for i, text in enumerate(b.column("text"), 1):
            parts.append((text.as_py() or "").encode())
            size += len(parts[-1])
            if size >= chunk_bytes or i == b.num_rows:
                ids.append(b.column("doc_id").slice(begin, i - begin))
                langs.append(b.column("lang").slice(begin, i - begin))
                begin = i
            if size >= chunk_bytes:
                yield _packed(chunk, ids, langs, parts)
                chunk, ids, langs, parts, size = chunk + 1, [], [], [], 0
    if parts:
        yield _packed(chunk, ids, langs, parts)


def _requests(batches: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    """The distinct n-grams of every length, and their contexts, that each chunk has."""
    for b in batches:
        for row in b.itertuples():
            found = np.zeros(0, np.int64)
            for piece in _pieces(iter(_texts(row)), order):
                found = np.union1d(found, piece)
            keys = [found, found >> 8, np.ones(1, np.int64)]
            for k in range(order - 1, 0, -1):
                tails = np.unique(shorter(found, k))
                keys += [tails, tails >> 8]
            yield pd.DataFrame({"chunk": row.chunk, "key": np.unique(np.concatenate(keys))})


def _texts(row) -> list[bytes]:
    blob = zstandard.decompress(row.texts)
    return [blob[a:b] for a, b in zip([0, *row.ends[:-1]], row.ends)]


def _scored(answers: pd.DataFrame, chunks: pd.DataFrame, order: int) -> pd.DataFrame:
    """(doc_id, lang, n_bytes, log_prob) of a chunk's documents."""
    answers = answers.sort_values("key")
    keys, p, g = (answers[c].to_numpy() for c in ("key", "p", "g"))
    out = []

    def look(values: np.ndarray, at: np.ndarray, missing: float) -> np.ndarray:
        found = np.searchsorted(keys, at)
        hit = np.minimum(found, max(len(keys) - 1, 0))
        ok = (keys[hit] == at) & ~np.isnan(values[hit]) if len(keys) else np.zeros(len(at), bool)
        return np.where(ok, values[hit] if len(keys) else 0.0, np.nan if missing is None else missing)

    def probability(at: np.ndarray) -> np.ndarray:
        result = np.full(len(at), 1 / 256)
        for k in range(1, order + 1):
            gram = shorter(at, k)
            result = np.where(np.isnan(seen := look(p, gram, None)), look(g, gram >> 8, 1.0) * result, seen)
        return result

    for row in chunks.itertuples():
        texts = _texts(row)
        distinct = np.zeros(0, np.int64)
        for piece in _pieces(iter(texts), order):
            distinct = np.union1d(distinct, piece)
        logs = np.log(probability(distinct))
        total = [sum(float(logs[np.searchsorted(distinct, piece)].sum()) for piece in _pieces(iter([text]), order)) for text in texts]
        ids = pd.arrays.IntegerArray(np.frombuffer(row.ids, "<i8").astype(np.int64), ~np.frombuffer(row.known, bool))
        out.append(pd.DataFrame({"doc_id": ids, "lang": list(row.langs), "n_bytes": [len(t) for t in texts], "log_prob": total}))
    return pd.concat(out)


def log_probabilities(docs: DataFrame, model: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, lang, n_bytes, log_prob) of every row: the natural log of each whole text's probability, byte by byte.

    ``docs`` is read once. The chunks are a table in buckets of chunk numbers, so answers
    come to them and no chunk shares its task with many others.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "perplexity-chunks")
    schema = "chunk long, ids binary, known binary, langs array<string>, ends array<long>, texts binary"
    table, buckets = f"chunks_{uuid.uuid4().hex}", 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(lambda b: _chunks(b, chunk_bytes), schema)
    chunks.write.option("path", f"{stage.root}/chunks").option("compression", "none").bucketBy(buckets, "chunk").saveAsTable(table)
    try:
        asked = spark.table(table).mapInPandas(lambda b: _requests(b, order), "chunk long, key long")
        answers = asked.join(model, "key").select("chunk", "key", "p", "g")
        both = answers.groupBy("chunk").cogroup(spark.table(table).groupBy("chunk"))
        scores = stage.write(both.applyInPandas(lambda a, c: _scored(a, c, order), "doc_id long, lang string, n_bytes long, log_prob double"), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    stage.drop("chunks")
    return scores


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Trusted documents that the model doesn't see."""
    return F.pmod(F.xxhash64(doc_id, F.lit("held out")), F.lit(HELD_OUT)) == 0


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is labelled of good quality and not held out; a filter of fixed size spares most others the shuffle."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id").distinct()
    mask = docs.sparkSession.sparkContext.broadcast(_filter_words(good.withColumnRenamed("doc_id", "node"), FILTER_BITS))  # FILTER_BITS / 8 bytes

    @F.pandas_udf("boolean")
    def likely(ids: pd.Series) -> pd.Series:
        at = _bit(ids.fillna(-1).to_numpy(np.int64), FILTER_BITS)
        return pd.Series((mask.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    # Merged at every size: labels grow with the documents, so they are never sent whole.
    return docs.where(F.col("doc_id").isNotNull()).where(likely("doc_id")).join(good.hint("merge"), "doc_id", "left_semi")


def perplexity_filter(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_bytes, perplexity (per byte), threshold and kept.

    The threshold of a language is that quantile of its held-out trusted documents'
    perplexity; with n of them the language's (null too) own quantile counts
    n / (n + ``SHRINK``), that of all languages the rest. A null or empty text has no
    perplexity and is not kept. Without trusted text every byte is equally likely, and
    without held-out trusted text all texts with bytes are kept.
    """
    stage = Stage(docs.sparkSession, "perplexity")
    model = train(trusted_documents(docs, labels), order, stage)
    release(docs.sparkSession)  # the trusted texts' shuffle
    scores = log_probabilities(docs, model, order, chunk_bytes)
    stage.only()
    rows = scores.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_prob") / F.col("n_bytes")))).withColumn("key", F.coalesce("lang", F.lit("")))
    good = labels.where((F.col("quality") == 1) & held_out()).select("doc_id").distinct()
    known = rows.where("perplexity IS NOT NULL").join(good, "doc_id", "left_semi")
    bins = {"q": F.ceil(F.log("perplexity") * GRID)}
    known = stage.write(known.withColumn("everyone", F.lit(0)), "known")
    overall = grid_quantiles(known, "everyone", bins, (quantile,)).select(F.exp(F.col("q_0") / GRID).alias("q")).first()
    by_language = grid_quantiles(known, "key", bins, (quantile,)).select("key", "n", F.exp(F.col("q_0") / GRID).alias("q"))
    pooled = F.lit(float(overall["q"]) if overall else 1e9)
    limit = F.coalesce((F.col("n") * F.col("q") + SHRINK * pooled) / (F.col("n") + SHRINK), pooled)
    judged = rows.join(stage.write(by_language, "quantiles"), "key", "left").withColumn("threshold", limit)
    return judged.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
