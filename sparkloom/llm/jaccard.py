"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct word 4-shingles, as 64-bit hashes. Two sets link at a
Jaccard similarity of at least ``PERCENT`` / 100. All filters are exact:

1. Documents with equal sets (equal 128-bit digests; a set of one shingle by its words) are
   one node from here on. Sets too small to link with a different one end here.
2. In any fixed order of tokens, the first k tokens that two linked sets share lie in the
   first n - need + k tokens of each (need: the least overlap that a set of n can link
   with). By hash order with k = a tenth of the set, a node can only link if enough of its
   extended prefix is found in other sets. Most documents end here; only prefixes were
   shuffled.
3. The rest count all their tokens. A node needs ``need`` tokens that occur elsewhere.
4. Tokens are ordered rarest first and the prefix is extended for k = 2. Rare tokens are
   indexed singly, tokens of the frequent class by their 2-combinations. A node with too
   many frequent tokens to combine indexes them singly ("dense"), where the others meet
   it; a bucket without a dense node is left to the combinations.
5. Verification. Each member of a bucket is compared with the bucket's first; the verified
   links make components, and a bucket inside one component is done. In what remains only
   pairs across components count. A rare bucket has at most ``FREQUENT`` members, so its
   pairs are listed and verified, as are those of other buckets that are as small.
6. Members of open buckets that are larger go through 4 and 5 again with k = 3, then 4:
   sets that share no more than a few common tokens don't meet any more.
7. Buckets that even then are large and open are joined into blocks, and a block's nodes
   outside its largest component are compared with the block in cells of at most two chunks
   of ``CHUNK_TOKENS``: no task holds a large group, no pair is lost, and pairs inside the
   largest component are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.components import star_forest
from sparkloom.staging import Stage

from .common import put
from .hashing import mixed, text_bytes, window_hashes, word_hashes

SHINGLE = 4
PERCENT = 85
FREQUENT = 32
#: A node combines k frequent tokens if it has at most so many of them; combinations are of MOST_TOKENS at most.
COMBINED = {2: 16, 3: 12, 4: 10}
MOST_TOKENS = 4
CHUNK_TOKENS = 100_000
#: Bits of the filter that keeps most documents' tokens from being sent; a power of two.
FILTER_BITS = 1 << 24

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles; of fewer words, one for all."""
    for data, bounds in text_bytes(texts):
        words, first = word_hashes(_LOWER[data], bounds)
        shingles = window_hashes(words, size) if len(words) >= size else words
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a < size:
                yield window_hashes(words[a:b], b - a) if b > a else words[:0]
            else:
                s = np.sort(shingles[a : b - size + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def need(n, percent: int = PERCENT):
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def _extra(n):
    return np.maximum(1, n // 10)


def _identified(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each text's set and its identity, 128 bits as two signed integers.

    A set of one token goes by the words of its shingle, any other by its sorted tokens: two
    tokens or more have 128 bits among them, one has 64 only.
    """
    for i, s in enumerate(shingle_sets(texts, size)):
        if len(s) == 1:
            content = b" ".join(texts[i].as_py().encode().translate(_LOWER.tobytes()).split(None, size)[:size])
        else:
            content = s.tobytes()
        high, low = np.frombuffer(xxhash.xxh3_128_digest(content), np.int64)
        yield s, int(high), int(low)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, high, low, prefix = [], [], [], []
        for s, h, l in _identified(b.column("text"), size):
            n.append(len(s))
            high.append(h)
            low.append(l)
            prefix.append(s[: len(s) - need(len(s), percent) + int(_extra(len(s)))] if len(s) else s)
        rest = b.drop_columns("text")
        columns = [*rest.columns, pa.array(n, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(prefix)]
        yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "n", "high", "low", "prefix"])


def _bit(node: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(node.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _filter_words(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each node's hash; ``bits`` / 64 words at most reach the driver."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bit": _bit(b["node"].to_numpy(), bits)})

    bit = nodes.select("node").mapInPandas(place, "bit long")
    words = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("set")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets(docs: DataFrame, alive: DataFrame, size: int) -> DataFrame:
    """(high, low, n, tokens), once for each set whose ``high`` is among the alive ones."""
    mask = docs.sparkSession.sparkContext.broadcast(_filter_words(alive.withColumnRenamed("high", "node"), FILTER_BITS))  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for b in batches:
            high, low, sets = [], [], []
            for s, h, l in _identified(b.column("text"), size):
                at = int(_bit(np.array([h]), FILTER_BITS)[0])
                if len(s) and (h, l) not in sent and int(mask.value[at >> 6]) >> (at & 63) & 1:
                    sent.add((h, l))
                    high.append(h)
                    low.append(l)
                    sets.append(s)
            n = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64()), n, _lists(sets)], names=["high", "low", "n", "tokens"])

    found = docs.select("text").mapInArrow(run, "high long, low long, n int, tokens array<long>")
    return found.join(alive, "high", "left_semi").dropDuplicates(["high", "low"])


def _need(n: str, percent: int) -> Column:
    return F.expr(f"({percent} * {n} + 99) div 100")


def _candidates(docs: DataFrame, signed: DataFrame, stage: Stage, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(names, ranked): (node, high, low) of the nodes counted, and (node, n, ranked) of those that may link.

    ranked holds a node's tokens found elsewhere, rarest first. Up to the naming, sets go by
    half their digest; where two share it, their counts are added and the lower demand holds,
    so neither is lost.
    """
    # A set that is all of another but for one token must be this large to link; smaller ones link with equal sets alone.
    signed = signed.where(100 * F.col("n") >= percent * (F.col("n") + 1))
    sets = signed.groupBy("high", "low").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    sizes = stage.write(sets.groupBy("high").agg(F.min("n").alias("n"), F.min("copies").alias("copies")), "sizes")
    rows = signed.select("high", F.explode("prefix").alias("token"))
    # Counts are written before they are joined, so that the join can split a hot token's rows.
    shared = stage.write(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    hits = rows.join(shared, "token").groupBy("high", "c").agg(F.count(F.lit(1)).alias("k")).join(sizes, "high")
    alive = (
        hits.groupBy("high").agg(F.max("copies").alias("copies"), F.max("n").alias("n"), F.sum(F.when(F.col("c") > F.col("copies"), F.col("k")).otherwise(0)).alias("found"))
        .where(F.col("found") >= F.col("copies") * F.greatest(F.lit(1), F.floor(_need("n", percent) / 10)))
    )
    alive = stage.write(alive.select("high"), "alive")
    stage.drop("shared")
    sets = stage.write(_sets(docs, alive, size).withColumn("node", F.monotonically_increasing_id()), "sets")  # the number is kept in the table
    names, left, last = sets.select("node", "high", "low"), sets.count(), None
    for step in range(4):
        token = sets.select("node", "n", F.explode("tokens").alias("token"))
        df = stage.write(token.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), f"df{step}")
        ranked = token.join(df, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        ranked = stage.write(ranked.where(F.size("ranked") >= _need("n", percent)), f"ranked{step}")
        stage.drop(f"df{step}")
        if last:
            stage.drop(last)
        before, left, last = left, ranked.count(), f"ranked{step}"
        if left > 0.9 * before:
            break
        # Fewer nodes leave fewer tokens that occur elsewhere.
        sets = ranked.select("node", "n", F.col("ranked.token").alias("tokens"))
    return names, ranked


def _combined(tokens: Column, k: int) -> Column:
    """Hashes of all combinations of ``k`` of the tokens, in their order."""
    found = F.transform(tokens, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    for _ in range(k - 1):
        found = F.flatten(F.transform(found, lambda c: F.transform(F.slice(tokens, c["i"] + 2, F.size(tokens)), lambda y, j: F.struct(F.xxhash64(c["h"], y).alias("h"), (c["i"] + 1 + j).alias("i")))))
    return F.transform(found, lambda c: c["h"])


def _keys(ranked: DataFrame, percent: int, frequent: int, most: int, k: int = 2) -> DataFrame:
    """(kind, key, dense, node, n): kind 0 rare token, 1 frequent token, ``k`` a combination of k frequent tokens."""
    slots = F.greatest(F.lit(0), F.size("ranked") - _need("n", percent) + k).cast("int")  # tokens found nowhere else come first
    part = ranked.select("node", "n", F.slice("ranked", F.lit(1), slots).alias("part"))
    part = part.select("node", "n", F.filter("part", lambda r: r["df"] <= frequent)["token"].alias("rare"), F.filter("part", lambda r: r["df"] > frequent)["token"].alias("often"))
    dense = (F.size("often") > most) | (_need("n", percent) < k)  # a set that links by fewer tokens has no combination to meet in
    few = F.size("often").between(k, most)
    key = lambda kind, of, dense: F.transform(of, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("key"), dense.alias("dense")))
    combined = _combined(F.when(few, F.col("often")).otherwise(F.array().cast("array<bigint>")), k)
    all_ = F.concat(key(0, F.col("rare"), F.lit(False)), key(1, F.col("often"), dense), key(k, combined, F.lit(False)))
    return part.select("node", "n", F.explode(all_).alias("k")).select("k.*", "node", "n")


def _linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their whole sets."""
    left, right = (tokens.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(star_forest(links, "a", "b").withColumnRenamed("component", "label"), F.col("node") == F.col("id"), "left").drop("id").withColumn("label", F.coalesce("label", "node"))


def _cell_links(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join the components of a cell; side 0 is compared with itself or, where there is one, with side 1."""
    cell = cell.sort_values(["side", "node"], ignore_index=True)
    m, size, side, node = len(cell), cell["n"].to_numpy(np.int64), cell["side"].to_numpy(), cell["node"].to_numpy()
    lengths = cell["tokens"].map(len).to_numpy()
    values, token, counts = np.unique(np.concatenate(cell["tokens"].to_numpy()), return_inverse=True, return_counts=True)
    owner, begin = np.repeat(np.arange(m), lengths), np.concatenate([[0], np.cumsum(lengths)])
    rarest = np.lexsort((token, counts[token], owner))  # each set's tokens rarest first, in an order common to all
    token = token[rarest]
    place = np.arange(len(token)) - np.repeat(begin[:-1], lengths)
    # What a set lacks here can't be shared here, so its prefix is shorter by as much.
    prefix = np.flatnonzero(place <= np.repeat(lengths - need(size, percent), lengths))
    order = prefix[np.argsort(token[prefix], kind="stable")]
    postings, at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token[prefix], minlength=len(values)))])
    _, label = np.unique(cell["label"].to_numpy(), return_inverse=True)
    two, mark, links = side.any(), np.zeros(len(values), bool), []
    for a in np.flatnonzero(side == 0):
        mine = token[begin[a] : begin[a + 1]]
        first = mine[: max(0, lengths[a] - need(size[a], percent) + 1)]
        count = at[first + 1] - at[first]
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            continue
        met = np.unique(postings[np.arange(ends[-1]) + np.repeat(at[first] - (ends - count), count)])
        met = met[(label[met] != label[a]) & (side[met] == 1 if two else met != a) & (100 * np.minimum(size[met], size[a]) >= percent * np.maximum(size[met], size[a]))]
        mark[mine] = True
        while len(met):
            some, met = met[:64], met[64:]
            n = lengths[some]
            spots = np.arange(n.sum()) + np.repeat(begin[some] - (np.cumsum(n) - n), n)
            both = np.add.reduceat(mark[token[spots]].astype(np.int64), np.cumsum(n) - n)
            for b in some[100 * both >= percent * (size[a] + size[some] - both)]:
                if label[b] != label[a]:
                    links.append((node[a], node[b]))
                    label[label == label[b]] = label[a]
            met = met[label[met] != label[a]]
        mark[mine] = False
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _block_links(members: DataFrame, tokens: DataFrame, stage: Stage, percent: int, chunk_tokens: int) -> DataFrame:
    """Links across components within buckets of any size; ``members`` are (kind, key, node, label)."""
    heads = stage.write(members.groupBy("kind", "key").agg(F.min("label").alias("head")), "heads")
    edges = members.join(heads, ["kind", "key"]).select("label", "head").distinct()  # components of buckets' components
    blocks = star_forest(edges, "label", "head").withColumnRenamed("component", "block")
    nodes = stage.write(members.select("node", "label").distinct(), "block-nodes")
    nodes = nodes.join(blocks, F.col("label") == F.col("id"), "left").withColumn("block", F.coalesce("block", "label")).join(tokens, "node")
    nodes = stage.write(nodes.select("block", "label", "node", "n", "tokens"), "blocks")
    weights = nodes.groupBy("block", "label").agg(F.sum(F.size("tokens")).alias("w"))
    largest = stage.write(weights.groupBy("block").agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("all")), "largest")
    chunks = lambda w: F.ceil(w / chunk_tokens).cast("int")
    dealt = nodes.join(
        largest.select("block", F.col("most.label").alias("main"), chunks(F.col("most.w")).alias("mains"), F.greatest(F.lit(1), chunks(F.col("all") - F.col("most.w"))).alias("others")), "block"
    )
    own = F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("is_main", F.col("label") == F.col("main"))
    cell = lambda i, j, main: F.struct(i.alias("i"), j.alias("j"), F.lit(main).alias("with_main"))
    with_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: cell(i, F.col("own"), True))
    to_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: cell(F.col("own"), j, True))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: cell(F.least(k, F.col("own")), F.greatest(k, F.col("own")), False))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("is_main"), with_main).otherwise(F.concat(to_main, among)))).select("block", "cell.*", "own", "is_main", "label", "node", "n", "tokens")
    side = F.when(F.col("with_main"), F.col("is_main").cast("int")).otherwise((F.col("own") != F.col("i")).cast("int"))
    keys = ["block", "with_main", "i", "j"]
    cells = cells.withColumn("side", side).drop("own", "is_main").repartition(*keys)  # else all cells of a block would follow the join's partition
    return cells.groupBy(*keys).applyInPandas(lambda c: _cell_links(c, percent), "a long, b long")


def _bucket_links(keyed: DataFrame, tokens: DataFrame, links: DataFrame | None, stage: Stage, percent: int, frequent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, met, large): ``links`` with those that the buckets of ``keyed`` give, their members, and the large buckets still open.

    A bucket whose members are in one component by now is done; of one with at most
    ``frequent`` members the pairs across components are verified; a larger one is left.
    """
    keyed = stage.write(keyed, f"keys{k}")
    buckets = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("c"), F.max("dense").alias("any_dense"), F.min(F.struct("node", "n")).alias("first")).where("c > 1 AND (kind <> 1 OR any_dense)")
    buckets = stage.write(buckets.select("kind", "key", "c", "first"), f"buckets{k}")
    met = keyed.join(buckets, ["kind", "key"])
    star = met.where((F.col("node") != F.col("first.node")) & _near_in_size(F.col("n"), F.col("first.n"), percent)).select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct()
    found = stage.write(_linked(stage.write(star, f"star{k}"), tokens, percent), f"star-links{k}")
    links = found if links is None else links.unionByName(found)
    label = stage.write(_labelled(tokens.select("node"), links), f"labels{k}")
    rows = stage.write(met.join(label, "node").select("kind", "key", "node", "n", "label"), f"met{k}")
    mixed_ = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("c"), (F.min("label") != F.max("label")).alias("open")).where("open").select("kind", "key", "c")
    mixed_ = stage.write(mixed_, f"open{k}")
    small = rows.join(mixed_.where(F.col("c") <= frequent), ["kind", "key"]).groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("node", "n", "label"))).alias("of"))  # at most ``frequent`` members
    pair = F.transform("of", lambda x, i: F.transform(F.filter(F.slice("of", i + 2, F.size("of")), lambda y: (y["label"] != x["label"]) & _near_in_size(x["n"], y["n"], percent)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))))
    pairs = small.select(F.explode(F.flatten(pair)).alias("p")).select("p.*").distinct()
    links = links.unionByName(stage.write(_linked(stage.write(pairs, f"pairs{k}"), tokens, percent), f"pair-links{k}"))
    return links, rows, mixed_.where(F.col("c") > frequent)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, most: int = COMBINED[2], chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, __rid (if given), n_shingles, component_id and component.

    component_id is the least doc_id reachable by links. Equal sets link. A null, empty or
    wordless text has no set, no links and its own doc_id as component_id; its component is
    null. Null doc_ids lose to others. Other columns are not carried.
    """
    stage = Stage(docs.sparkSession, "jaccard")
    keys = ["doc_id", *(["__rid"] if "__rid" in docs.columns else [])]
    kinds = "".join(f"{k} {dict(docs.dtypes)[k]}, " for k in keys)
    signed = stage.write(docs.select(*keys, "text").mapInArrow(lambda b: _signatures(b, size, percent), f"{kinds}n int, high long, low long, prefix array<long>"), "signed")
    names, ranked = _candidates(docs, signed, stage, size, percent)
    tokens = ranked.select("node", "n", F.col("ranked.token").alias("tokens"))
    links = met = None
    for k in range(2, MOST_TOKENS + 1):
        keyed = _keys(ranked, percent, frequent, min(most, COMBINED[k]), k)
        links, met, large = _bucket_links(keyed, tokens, links, stage, percent, frequent, k)
        if large.isEmpty():
            break
        # What has met in large buckets alone meets by more tokens, which fewer sets share.
        left = stage.write(met.join(large.select("kind", "key"), ["kind", "key"]).select("node").distinct(), f"left{k}")
        ranked = ranked.join(left, "node", "left_semi")
    else:
        label = stage.write(_labelled(tokens.select("node"), links), "labels-again")
        members = stage.write(met.drop("label").join(large.select("kind", "key"), ["kind", "key"]).join(label, "node").select("kind", "key", "node", "label"), "members")
        links = links.unionByName(stage.write(_block_links(members, tokens, stage, percent, chunk_tokens), "block-links"))

    groups = star_forest(links, "a", "b").withColumnRenamed("id", "node")
    named = names.join(groups, "node", "left").select("high", "low", F.coalesce("component", "node").alias("group"))
    named = stage.write(named, "groups")  # written, so that the join can split a large set's rows
    # Sets that no filter let through are components of their own.
    component = F.when(F.col("n") > 0, F.coalesce(F.col("group").cast("string"), F.concat_ws(":", "high", "low")))
    rows = stage.write(signed.join(named, ["high", "low"], "left").select(*keys, "n", component.alias("component")), "rows")
    stage.only("rows")
    least = stage.write(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least, "component", "left")
    return out.select(*keys, F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "component")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The row of each group with the least doc_id; rows without a set all stay. Columns as they were."""
    stage = Stage(docs.sparkSession, "jaccard-docs")
    numbered = stage.write(put(docs, __rid=F.monotonically_increasing_id()), "numbered")
    found = stage.write(near_duplicates(numbered, **options), "found")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid")).alias("first")).select(F.col("first.__rid").alias("__rid"))
    stay = first.union(found.where("component IS NULL").select("__rid"))
    return numbered.join(stay, "__rid", "left_semi").drop("__rid")
