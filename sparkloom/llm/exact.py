"""Exact duplicates by deterministic block naming.

Every text (A-Z lower-cased, UTF-8) is cut into blocks of ``BLOCK`` bytes, the last
one shorter. All blocks are sorted (by digest, see below) and each distinct block gets its
rank as an integer name. Then adjacent names of a document are paired, the pairs are sorted and named in
the same way, and so on until a document has one name; an odd last name moves up as it
is. A name stands for one string only, and equal strings always meet in the same name,
so the last name is an identity without collisions.

Blocks are ordered by their SHA-256 digest, so that the sample from which the sort's
ranges are chosen stays small; neighbours of equal digest are compared in full, and two
different blocks of one digest would stop the run rather than share a name.

The sort key ends in the row's own number. A block that a third of all rows share is
therefore dealt over many tasks; tasks whose first block equals the last block of the
task before continue its name (see ``_offsets``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.staging import Stage

from .common import ascii_lower, put

BLOCK = 2048
#: Names of level k start at k << LEVEL_BITS.
LEVEL_BITS = 54


def _ranker(keys: list[str], carried: list[str], content: str | None = None):
    """Ranks sorted rows within the task; the last row tells what the task began and ended with."""

    def run(batches):
        task, rank, last, first, kept = TaskContext.get().partitionId(), -1, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k)
                if batch.num_rows > 1:
                    changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            begin = [batch.column(k)[0].as_py() for k in keys]
            changed[0] = begin != last
            first = begin if first is None else first
            if content:
                whole = batch.column(content)
                other = np.full(batch.num_rows, whole[0].as_py() != kept)
                if batch.num_rows > 1:
                    other[1:] = pc.not_equal(whole.slice(1), whole.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                if (other & ~changed).any():
                    raise ValueError("two different blocks have one SHA-256 digest")
                kept = whole[batch.num_rows - 1].as_py()
            ranks = rank + np.cumsum(changed)
            rank, last = int(ranks[-1]), [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task, np.int32)), pa.array(ranks.astype(np.int64)), *[batch.column(c) for c in carried]]
                + [pa.nulls(n, batch.schema.field(k).type) for k in keys] * 2,
                names=["task", "rank", *carried, *[f"first_{k}" for k in keys], *[f"last_{k}" for k in keys]],
            )
        if first is not None:
            kinds = [batch.schema.field(k).type for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([rank + 1], pa.int64()), *[pa.nulls(1, batch.schema.field(c).type) for c in carried]]
                + [pa.array([v], t) for row in (first, last) for v, t in zip(row, kinds)],
                names=["task", "rank", *carried, *[f"first_{k}" for k in keys], *[f"last_{k}" for k in keys]],
            )

    return run


def _offsets(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(task, offset) for each task, from the one summary row that each task wrote."""
    by_task = Window.orderBy("task")
    ends = ranked.where("rid IS NULL").select("task", "rank", *[f"first_{k}" for k in keys], *[f"last_{k}" for k in keys])
    goes_on = F.lit(True)
    for k in keys:
        goes_on = goes_on & F.coalesce(F.lag(f"last_{k}").over(by_task) == F.col(f"first_{k}"), F.lit(False))
    ends = ends.withColumn("on", goes_on.cast("long"))
    before = F.coalesce(F.sum(F.col("rank") - F.col("on")).over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.select("task", (before - F.col("on")).alias("offset"))


def _named(stage: Stage, rows: DataFrame, keys: list[str], carried: list[str], level: int, content: str | None = None) -> DataFrame:
    """``carried`` and the integer name of each row's ``keys``; rows are (keys, content, carried), with rid among carried."""
    types = dict(rows.dtypes)
    kinds = lambda names, as_: [f"{p}{n} {types[n]}" for p in as_ for n in names]
    schema = ", ".join(["task int", "rank long", *kinds(carried, [""]), *kinds(keys, ["first_", "last_"])])
    dealt = rows.select(*keys, *([content] if content else []), *carried).repartitionByRange(*keys, "rid").sortWithinPartitions(*keys, "rid")
    ranked = stage.write(dealt.mapInArrow(_ranker(keys, carried, content), schema), f"ranked{level}")
    offsets = F.broadcast(_offsets(ranked, keys))  # one row of 12 bytes for each task
    name = F.lit(level << LEVEL_BITS) + F.col("rank") + F.col("offset")
    return ranked.where("rid IS NOT NULL").join(offsets, "task").select(*carried, name.alias("name"))


def block_identities(docs: DataFrame, block: int = BLOCK, stage: Stage | None = None) -> DataFrame:
    """(rid, doc_id, text_sha256, identity), one row for each row of ``docs``.

    rid numbers the rows. A null text counts as empty; an empty text is one empty block.
    Two rows have the same identity exactly if their normalised texts are equal. The tables
    that it reads are in ``stage``.
    """
    stage = stage or Stage(docs.sparkSession, "block-names")
    content = F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8")
    rid = F.col("__rid") if "__rid" in docs.columns else F.monotonically_increasing_id()
    cut = docs.select(rid.alias("rid"), "doc_id", content.alias("bytes")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("bytes") / block)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    blocks = cut.select("rid", "doc_id", "n", F.unhex(F.sha2("bytes", 256)).alias("sha"), F.posexplode(parts).alias("idx", "block"))
    first = F.col("idx") == 0
    blocks = blocks.withColumn("doc_id", F.when(first, F.col("doc_id"))).withColumn("sha", F.when(first, F.col("sha")))
    blocks = blocks.withColumn("digest", F.unhex(F.sha2("block", 256)))
    rows = _named(stage, blocks, ["digest"], ["rid", "idx", "n", "doc_id", "sha"], 0, content="block")
    heads = rows.where("idx = 0").select("rid", "doc_id", "sha")
    rows = rows.select("rid", "idx", "n", "name")
    done, level = [rows.where("n = 1")], 0
    most = rows.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = (
            rows.where("n > 1")
            .groupBy("rid", F.expr("idx div 2").cast("int").alias("half"), "n")
            .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"))
            .select("rid", F.col("half").alias("idx"), F.expr("(n + 1) div 2").cast("int").alias("n"), "a", "b")
        )
        pairs = stage.write(pairs, f"pairs{level}")
        named = _named(stage, pairs.where("b IS NOT NULL"), ["a", "b"], ["rid", "idx", "n"], level)
        rows = named.unionByName(pairs.where("b IS NULL").select("rid", "idx", "n", F.col("a").alias("name")))
        done.append(rows.where("n = 1"))
    ids = done[0]
    for x in done[1:]:
        ids = ids.unionByName(x)
    return heads.join(ids.select("rid", F.col("name").alias("identity")), "rid").select(
        "rid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "identity"
    )


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256, identity.

    Of equal texts the row with the largest doc_id stays (a null doc_id is the smallest);
    of repeated rows with that doc_id, one. group_size counts rows. An empty table gives
    no rows.
    """
    stage = Stage(docs.sparkSession, "exact")
    ids = stage.write(block_identities(docs, block, stage), "identities")
    stage.only("identities")
    best = ids.groupBy("identity").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    best = stage.write(best, "best")  # written, so that the join can split a large group's rows
    return ids.join(best, "identity").select(
        "rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("best.rid") == F.col("rid")).alias("kept"), "text_sha256", "identity",
    )


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    stage = Stage(docs.sparkSession, "exact-docs")
    numbered = stage.write(put(docs, __rid=F.monotonically_increasing_id()), "numbered")
    stay = exact_duplicates(numbered, block).where("kept").select(F.col("rid").alias("__rid"))
    return numbered.join(stay, "__rid", "left_semi").drop("__rid")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
