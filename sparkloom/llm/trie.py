r"""Shared prefixes of conversations: a trie by prefix sums of hashes and heavy paths.

1. Turns are put in order by range partitions of (conv_id, turn, role, text). A task sums up its turns'
   digests as it reads: the prefix of a conversation is the polynomial x1*B^(d-1) + ... + xd
   modulo the prime 2**127 - 1, x being 127 bits of the SHA-256 of (role, text). Such sums can be
   continued, so a conversation may lie across tasks: the one that a task begins with gets
   the sum and count of the tasks before (two rows a task pass the driver).
2. A rebuilt conversation begins with another's head. Its prefixes follow from two heads
   of fewer than ``HEADS`` turns by arithmetic; no text moves again.
3. Equal (depth, prefix) are one node: counts and the least member are sums and minima.
4. Heavy paths. A node's heavy child is the one with the most members (of equal ones the least conv_id);
   a light child has at most half of its parent's members, so a way up crosses at most
   log2(conversations) light edges. A path ends in a leaf and is the end of
   the row of turns of the leaf's least conversation, from its last light node.
5. Paths are attached in rounds from the deepest: a path's total goes to the parent of its first node.
   A round reads the paths of its own depth only. Suffix sums along the paths, in blocks of
   ``BLOCK`` nodes, then give every subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.staging import Stage

#: A conversation's head is taken from the first of its hundred and has fewer turns than HEADS.
HUNDRED, HEADS = 100, 6
#: Nodes of a path that are summed in one window.
BLOCK = 4096
P = (1 << 127) - 1
B = int.from_bytes(hashlib.sha256(b"base of the prefix sums").digest()[:15], "little") | 1
_LOW = (1 << 64) - 1


def _split(values: list[int]) -> tuple[pa.Array, pa.Array]:
    """127-bit integers as two signed ones."""
    low = np.array([v & _LOW for v in values], np.uint64).view(np.int64)
    return pa.array(np.array([v >> 64 for v in values], np.int64)), pa.array(low)


def _joined(high: pa.Array, low: pa.Array) -> list[int]:
    return [(a << 64) | (b & _LOW) for a, b in zip(high.to_pylist(), low.to_pylist())]


def prefix_sums(turns: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, no, hi, lo, phi, plo, chars): each turn's number from 1, its prefix sum and the one before, and its text's length.

    Turns with a null conv_id belong to no conversation. Null roles and texts are empty; a
    null turn comes first, turns of one number stand by role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, no, total, first = TaskContext.get().partitionId(), None, 0, 0, None
        for batch in batches:
            numbers, sums, before, firsts = [], [], [], []
            for c, x in zip(batch.column("conv_id").to_pylist(), batch.column("x").to_pylist()):
                if c != conv:
                    if conv is not None and first is None:
                        first = (conv, no, total)
                    conv, no, total = c, 0, 0
                before.append(total)
                no, total = no + 1, (total * B + (int.from_bytes(x, "little") >> 129)) % P
                numbers.append(no)
                sums.append(total)
                firsts.append(first is None)
            yield table(task, [0] * len(sums), firsts, batch.column("conv_id"), numbers, sums, before, batch.column("chars"))
        if conv is not None:
            ends = [first or (conv, no, total), (conv, no, total)]
            yield table(task, [1, 2], [False, False], pa.array([e[0] for e in ends], pa.int64()), [e[1] for e in ends], [e[2] for e in ends], [0, 0], pa.nulls(2, pa.int64()))

    def table(task, kinds, firsts, convs, numbers, sums, before, chars) -> pa.RecordBatch:
        columns = [pa.array([task] * len(sums), pa.int32()), pa.array(kinds, pa.int32()), pa.array(firsts, pa.bool_()), convs, pa.array(numbers, pa.int64()), *_split(sums), *_split(before), chars]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["task", "kind", "first", "conv_id", "no", "hi", "lo", "phi", "plo", "chars"]
    schema = "task int, kind int, first boolean, conv_id long, no long, hi long, lo long, phi long, plo long, chars long"
    local = stage.write(dealt.select("conv_id", digest.alias("x"), F.length("text").cast("long").alias("chars")).mapInArrow(run, schema), "local")
    ends = sorted((r.task, r.kind, r.conv_id, r.no, (r.hi << 64) | (r.lo & _LOW)) for r in local.where("kind > 0").collect())  # two rows a task
    carry, open_ = {}, None
    for (task, _, c, n, s), (_, _, last, m, z) in zip(ends[::2], ends[1::2]):
        if open_ and open_[0] == c:
            carry[task] = open_[1:]
            n, s = open_[1] + n, (open_[2] * pow(B, n, P) + s) % P
        open_ = (c, n, s) if c == last else (last, m, z)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            for i, (task, first) in enumerate(zip(rows["task"], rows["first"])):
                if first and task in carry:
                    n, s = carry[task]
                    for hi, lo, k in (("hi", "lo", rows["no"][i]), ("phi", "plo", rows["no"][i] - 1)):
                        v = (s * pow(B, k, P) + ((rows[hi][i] << 64) | (rows[lo][i] & _LOW))) % P
                        rows[hi][i], rows[lo][i] = v >> 64, ((v & _LOW) ^ (1 << 63)) - (1 << 63)
                    rows["no"][i] += n
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], batch.schema.field(c).type) for c in names[3:]], names=names[3:])

    local = local.where("kind = 0")
    return local.mapInArrow(carried, schema.split(", ", 3)[3]) if carry else local.select(*names[3:])


def rebuilt_prefixes(turns: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(rows, convs): the prefixes of the rebuilt conversations, and each conversation with its rebuilt length.

    Conversation c begins with the first h turns of c - c % 100 (all if it has fewer, none if
    there is no such one; % truncates) and goes on with its own after its first h, where
    h = crc32(decimal c) % 6.
    """
    sums = stage.write(prefix_sums(turns, stage), "sums")
    head = F.array_sort(F.collect_list(F.when(F.col("no") < HEADS, F.struct("no", "hi", "lo", "chars"))))  # five turns at most
    own = stage.write(sums.groupBy("conv_id").agg(F.max("no").alias("n"), head.alias("head")), "convs")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % HUNDRED}).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))

    def at(heads: Column, k: Column) -> list[Column]:
        return [F.when(k > 0, F.get(heads, k - 1)[c]).otherwise(F.lit(0)) for c in ("hi", "lo")]

    cut = dict(zip(("own_hi", "own_lo", "base_hi", "base_lo"), (*at(F.col("head"), F.least("h", F.col("n").cast("int"))), *at(F.col("base_head"), F.col("taken")))))
    convs = stage.write(convs.withColumns(cut).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).drop("head"), "rebuilt")
    first = convs.where("taken > 0").select("conv_id", "length", "base_head", F.explode(F.slice("base_head", F.lit(1), F.col("taken"))).alias("t"))
    no = F.col("t.no").cast("int")
    first = first.select("conv_id", "length", F.col("t.no").alias("depth"), "t.hi", "t.lo", *(c.alias(n) for c, n in zip(at(F.col("base_head"), no - 1), ("phi", "plo"))), "t.chars")
    rest = sums.join(convs.select("conv_id", "h", "taken", "length", *cut), "conv_id").where("no > h")
    rest = rest.select("conv_id", "length", (F.col("no") - F.col("h") + F.col("taken")).alias("depth"), "hi", "lo", "phi", "plo", "chars", (F.col("no") - F.col("h")).alias("k"), *cut)
    powers = [pow(B, k, P) for k in range(512)]

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """own(no) + (base(taken) - own(h)) * B^(no - h), and the same one turn before."""
        for batch in batches:
            delta = [(b - a) % P for a, b in zip(_joined(batch.column("own_hi"), batch.column("own_lo")), _joined(batch.column("base_hi"), batch.column("base_lo")))]
            ks = batch.column("k").to_pylist()
            power = lambda k: powers[k] if k < len(powers) else pow(B, k, P)
            now = [(s + d * power(k)) % P if d else s for s, d, k in zip(_joined(batch.column("hi"), batch.column("lo")), delta, ks)]
            before = [(s + d * power(k - 1)) % P if d else s for s, d, k in zip(_joined(batch.column("phi"), batch.column("plo")), delta, ks)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "length", "depth")), *_split(now), *_split(before), batch.column("chars")], names=["conv_id", "length", "depth", "hi", "lo", "phi", "plo", "chars"])

    rest = rest.mapInArrow(shifted, "conv_id long, length long, depth long, hi long, lo long, phi long, plo long, chars long")
    return stage.write(first.unionByName(rest), "rows"), convs.select("conv_id", "length")


def end_digests(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256): the digest of the ids of the conversations that end at each node.

    Ids are put in order and joined by thousands; a task that digests a node reads only the joined texts, one after another.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "hi", "lo")]
    ends = rows.where("depth = length").select("conv_id", "depth", "hi", "lo").unionByName(convs.where("length = 0").select("conv_id", *zero))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("depth", "hi", "lo", F.shiftright("conv_id", 12).alias("chunk")).agg(ids.alias("ids"))
    keys = ["depth", "hi", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids"))):
                if now != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield made(done)
        if key:
            yield made([(*key, digest.hexdigest())])

    def made(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64() if i < 3 else pa.string()) for i in range(4)], names=[*keys, "ends_sha256"])

    return texts.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids").mapInArrow(run, "depth long, hi long, lo long, ends_sha256 string")


def heavy_paths(named: DataFrame, children: DataFrame, rows: DataFrame, stage: Stage) -> DataFrame:
    """(path, level, head, depth, conv_id, parent_conv_id, leaf, own): every node on its heavy path; the path is named by its leaf's conv_id."""
    above = children.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), "heavy")
    nodes = named.join(above, ["parent_conv_id", "depth"], "left").join(children.select("conv_id", "depth", "n_children"), ["conv_id", "depth"], "left")
    light = F.coalesce(F.col("conv_id") != F.col("heavy"), F.lit(True))
    value = F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("chars")).otherwise(F.lit(0))
    nodes = stage.write(nodes.select("conv_id", "depth", "parent_conv_id", "hi", "lo", light.alias("light"), F.col("n_children").isNull().alias("leaf"), value.alias("own")), "marked")
    leaves = nodes.where("leaf").select(F.col("conv_id").alias("path"))
    mine = rows.select(F.col("conv_id").alias("path"), "depth", "hi", "lo").join(leaves, "path", "left_semi")
    steps = stage.write(mine.join(nodes.where("depth > 0"), ["depth", "hi", "lo"]).drop("hi", "lo"), "steps")
    heads = steps.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("light"), F.col("depth"))), F.lit(0)).alias("head"), F.count_if("light").alias("level"))
    heads = stage.write(leaves.join(heads, "path", "left").fillna(0, ["head", "level"]), "heads")
    on = steps.join(heads, "path").where("depth >= head").drop("light")
    whole = heads.where("level = 0").withColumn("depth", F.lit(0).cast("long"))  # one path has the root
    root = nodes.where("depth = 0").select("depth", "conv_id", "parent_conv_id", "leaf", "own").join(whole, "depth")
    return stage.write(on.unionByName(root), "paths")


def subtree_sums(paths: DataFrame, stage: Stage) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node's subtree, itself included."""
    sums = lambda *by: [F.sum(c).alias(c) for c in by]
    top = paths.where("depth = head AND level > 0").select("path", F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    up = top.join(paths.select("conv_id", "depth", F.col("path").alias("up")), ["conv_id", "depth"]).select("path", "up", F.col("depth").alias("up_depth"))
    totals = paths.groupBy("path", "level").agg(F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("own").alias("saved"))
    where = f"{stage.root}/totals"
    totals = totals.join(up, "path", "left")
    totals.write.partitionBy("level").parquet(where)  # a round reads its level alone
    totals, attached = paths.sparkSession.read.schema(totals.schema).parquet(where), []
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):  # log2(conversations) at most
        now = totals.where(F.col("level") == level).select("path", "up", "up_depth", "leaves", "saved")
        if attached:
            more = attached[-1].groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            now = now.join(more, "path", "left").select("up", "up_depth", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        attached.append(stage.write(now.groupBy("up", "up_depth").agg(*sums("leaves", "saved")), f"attached{level}"))
    values = paths.select("path", "depth", "conv_id", F.col("leaf").cast("long").alias("leaves"), F.col("own").alias("saved"))
    for table in attached[:1]:
        for more in attached[1:]:
            table = table.unionByName(more)
        got = table.select(F.col("up").alias("path"), F.col("up_depth").alias("depth"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        values = values.join(got, ["path", "depth"], "left").select("path", "depth", "conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
    values = stage.write(values.withColumn("block", F.expr(f"depth div {BLOCK}")), "values")
    below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy("path", "block").agg(*sums("leaves", "saved"))
    blocks = blocks.select("path", "block", *(F.sum(c).over(below).alias(f"below_{c}") for c in ("leaves", "saved"))).where("below_leaves IS NOT NULL")
    suffix = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inside = values.select("path", "block", "conv_id", "depth", *(F.sum(c).over(suffix).alias(c) for c in ("leaves", "saved")))
    out = inside.join(blocks, ["path", "block"], "left")
    return out.select("conv_id", "depth", *((F.col(c) + F.coalesce(f"below_{c}", F.lit(0))).alias(n) for c, n in (("leaves", "n_leaves"), ("saved", "saved_tokens"))))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Nulls and ties
    are settled as in ``prefix_sums``, repeated rows are turns of their own, texts of any
    length enter as digests. A table without conversations gives no rows.
    """
    stage = Stage(turns.sparkSession, "trie")
    rows, convs = rebuilt_prefixes(turns, stage)
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("depth", "hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("phi").alias("phi"), F.min("plo").alias("plo"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in ("depth", "hi", "lo")), "conv_id", "n_convs", *(zero.alias(c) for c in ("chars", "phi", "plo")))
    nodes = stage.write(nodes.unionByName(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"))
    named = stage.write(nodes.join(above, ["depth", "phi", "plo"], "left").drop("phi", "plo"), "named")
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("minus")))
    children = named.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), (-largest["minus"]).alias("heavy"))
    children = stage.write(children, "children")
    sums = stage.write(subtree_sums(heavy_paths(named, children, rows, stage), stage), "subtrees")
    ends = stage.write(end_digests(rows, convs), "ends")
    stage.only("named", "children", "subtrees", "ends")
    out = named.join(children.drop("heavy"), ["conv_id", "depth"], "left").join(sums, ["conv_id", "depth"]).join(ends, ["depth", "hi", "lo"], "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
n AS (SELECT c.*, least(h, (SELECT count(*) FROM t WHERE t.conv_id = c.base)) AS taken FROM c),
r AS (SELECT n.conv_id, t.no AS depth, t.role, t.text FROM n JOIN t ON t.conv_id = n.base AND t.no <= n.h
    UNION ALL SELECT n.conv_id, t.no - n.h + n.taken, t.role, t.text FROM n JOIN t ON t.conv_id = n.conv_id AND t.no > n.h),
p AS (SELECT conv_id, depth, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
    UNION ALL SELECT conv_id, 0, 0, [] FROM n),
m AS (SELECT conv_id, depth, chars, min(conv_id) OVER g AS node, count(*) OVER g AS members, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p WINDOW g AS (PARTITION BY depth, prefix)),
e AS (SELECT node, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM m WHERE ends GROUP BY ALL),
d AS (SELECT a.node AS conv_id, a.depth, b.node AS parent_conv_id, a.members AS n_convs, (a.members - 1) * a.chars AS own FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 WHERE a.conv_id = a.node),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM d WHERE depth > 0 GROUP BY ALL),
s AS (SELECT m.node AS conv_id, m.depth, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum(d.own)::BIGINT AS saved_tokens
    FROM d LEFT JOIN k USING (conv_id, depth) JOIN m ON m.conv_id = d.conv_id AND m.depth <= d.depth GROUP BY ALL)
SELECT d.conv_id, d.depth, d.parent_conv_id, d.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM d JOIN s USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth) LEFT JOIN e ON e.node = d.conv_id AND e.depth = d.depth
"""
