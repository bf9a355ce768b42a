"""Mixing sources to target weights by systematic sampling [native].

Each source's expected number of copies per document is target / size. The
prefix sum of expected copies within the source, plus one random offset for the
source, crosses integer boundaries; a document is emitted once for each boundary
it crosses. Documents of a source are ordered by size, so the words taken follow
the target up to about one document.

No group is ever ordered in one task: a document's rank in its source is the sum of
the counts of smaller sizes (from a table of one row per source and size), of the
counts of earlier hash buckets of the same size, and of its rank within its bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, put

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets for a table (no_source, source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn. Together they share all
    sizes; a target stops at ``max_repeat`` times its source's size and the excess goes
    to the others by weight. The common level is found in closed form: order sources
    by cap / weight; the first whose share at its prefix's level fits its cap sets it.
    """
    by_name = Window.orderBy("no_source", "source")
    everything = Window.partitionBy()
    ranked = sizes.withColumn("_rn", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rn") - 1) % len(weights) + 1).cast("int"))
    )
    before = Window.orderBy("_ratio", "_rn").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_cap_before")) / (F.col("_weights") - F.col("_weight_before")))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    )
    return level.select(
        "no_source", "source", "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken.

    A null text has size 0; a null source is a source of its own, the last. Rows of
    size 0 take 0 words whatever their copies. Repeated rows count one by one. Input
    columns named like an output column are replaced. An empty table stays empty.
    """
    base = (
        docs.withColumn("__size", n_words(F.col("text")))
        .withColumn("__none", F.col("source").isNull())
        .withColumn("__source", F.coalesce("source", F.lit("")))
        .withColumn("__bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3))
        .withColumn("__tie", F.xxhash64("text"))
    )
    keys = ["__none", "__source", "__size", "__bucket"]
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    by_size = counts.groupBy(*keys[:3]).agg(F.sum("__n").alias("__n"))
    sources = by_size.groupBy(*keys[:2]).agg(F.sum(F.col("__n") * F.col("__size")).alias("source_size"))
    targets = source_targets(
        sources.select(F.col("__none").alias("no_source"), F.col("__source").alias("source"), "source_size"), weights, max_repeat
    ).select(F.col("no_source").alias("__none"), F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    earlier = Window.unboundedPreceding, -1
    sizes = by_size.withColumn("__before_size", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys[:2]).orderBy("__size").rowsBetween(*earlier)), F.lit(0))).drop("__n")
    buckets = counts.withColumn("__before_bucket", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys[:3]).orderBy("__bucket").rowsBetween(*earlier)), F.lit(0))).drop("__n")
    offsets = buckets.join(sizes, keys[:3]).join(targets, keys[:2])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.when(F.col("__none"), F.lit("-")).otherwise(F.concat(F.lit("+"), "__source"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "__tie")) + F.col("__before_size") + F.col("__before_bucket")
    placed = (
        base.join(offsets, keys)
        .withColumn("__rank", rank)
        .withColumn("__rate", F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0)))
        .withColumn("__offset", offset)
        .withColumn("__copies", F.least(F.lit(max_repeat).cast("long"), F.floor(F.col("__rate") * F.col("__rank") + F.col("__offset")) - F.floor(F.col("__rate") * (F.col("__rank") - 1) + F.col("__offset"))))
    )
    out = put(
        placed, size=F.col("__size"), source_size=F.col("__source_size"), target=F.col("__target"),
        copies=F.col("__copies"), taken=F.col("__size") * F.col("__copies"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row as many times as ``copies`` says, with its copy number from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source IS NULL AS ns, coalesce(source, '') AS s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
w AS (SELECT ns, s, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY ns, s) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY ns, s) AS rn FROM d GROUP BY ns, s),
c AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS lv FROM c
    WINDOW b AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT ns, s, source_size, least(cap, coalesce((SELECT max(lv) FROM l WHERE lv <= ratio), 0) * weight) AS target,
    ('0x' || substr(md5('{SEED}|' || CASE WHEN ns THEN '-' ELSE '+' || s END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.ns, d.s ORDER BY d.size, substr(md5(d.doc_id::VARCHAR), 1, 3), d.doc_id) AS k FROM d JOIN t USING (ns, s))
SELECT doc_id, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM (
    SELECT *, least(3, floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT AS copies FROM r)
"""
