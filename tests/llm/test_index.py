"""Conversation tries, token files and lexical search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lexical, tokens, trie
from sparkloom.llm.common import tokenizer_file

TURNS = "conv_id long, turn long, role string, text string, hi string, depth string"
DOCS = "doc_id long, text string, n_tokens string, score string"
VOCABULARY = "byte_bpe_50k.json"


# Conversation trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    name = {p: min(m) for p, m in members.items()}
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return {(name[p], len(p), name[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()}


def conversations():
    rng, rows = random.Random(9), []
    for c in [*range(0, 130), *range(300, 320), 5000, -7, 2**40, 2**40 + 1, 907]:
        for turn in range(rng.choice((1, 1, 2, 3, 5, 7, 9))):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(("hello", "hello", "", "ok é", "x" * 50, "日本")) if turn < 4 else rng.choice("ab"), "clash", "clash"))
    rows += [(1, None, None, None, "", ""), (1, 0, "user", "tie", "", ""), (1, 0, "bot", "tie", "", ""), (2, 1, "user", "same", "", ""), (2, 1, "user", "same", "", ""), (None, 0, "user", "lost", "", "")]
    rows += [(77, i, "user", str(i % 3), "", "") for i in range(700)]  # over many tasks and paths of several blocks
    rows += [(1000 + i, 0, "user", "one of many", "", "") for i in range(60)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_trie(spark, monkeypatch, partitions):
    monkeypatch.setattr(trie, "BLOCK", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would come in one task
    try:
        rows = conversations()
        got = trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(partitions)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_trie(rows)


def test_trie_of_nothing_and_of_empty_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], TURNS)).count() == 0
    # With h of 5 or less of its own turns dropped and no base, a conversation may be turnless.
    empty = [c for c in range(101, 400) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "x", "", "") for c in empty]
    got = trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert set(map(tuple, got)) == plain_trie(rows) and len(got) == 1 and got[0].n_convs == 3


def test_prefix_sums_continue_over_tasks(spark):
    """One conversation over several range partitions, numbered and summed as if it were in one."""
    rows = [(5, i, "user", f"t{i}", "", "") for i in range(3000)] + [(4, 0, "user", "a", "", ""), (6, 0, "user", "b", "", "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stage = trie.Stage(spark, "test")
        found = trie.prefix_sums(spark.createDataFrame(rows, TURNS).repartition(6), stage).collect()
        tasks = stage.spark.read.parquet(f"{stage.root}/local").where("kind = 0 AND conv_id = 5").select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, []
    for i in range(3000):
        digest = hashlib.sha256(f"4:usert{i}".encode()).digest()
        before, total = total, (total * trie.B + (int.from_bytes(digest, "little") >> 129)) % trie.P
        want.append((5, i + 1, total, before))
    whole = lambda a, b: (a << 64) | (b & (1 << 64) - 1)
    assert tasks > 1 and sorted((r.conv_id, r.no, whole(r.hi, r.lo), whole(r.phi, r.plo)) for r in found if r.conv_id == 5) == want
    assert {(r.conv_id, r.no, r.chars) for r in found if r.conv_id != 5} == {(4, 1, 1), (6, 1, 1)}


# Token files


def test_value_coding():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = rng.integers(0, 9, rng.integers(1, 30))
        values = (rng.random(int(counts.sum())) * 2.0 ** rng.integers(0, 33, int(counts.sum()))).astype(np.uint32)
        control, c, data, d = tokens.pack_values(values, counts)
        assert (tokens.unpack_values(control, data, counts) == values).all()
        for i, n in enumerate(counts):  # a document can be cut out
            at = int(counts[:i].sum())
            assert (tokens.unpack_values(control[c[i] : c[i + 1]], data[d[i] : d[i + 1]], np.array([n])) == values[at : at + n]).all()
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)


def odd_texts(rng, n):
    alphabet = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "The", "é", "　", " ", "\u0085", "\x1c", "\x00", "'s", "'", "12", ".", "!", "<|endoftext|>", "́", "日", "\xa0", "​", "ß", "Ⅷ", "😀", "\x7f", "Ã", "À,"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_pieces_are_the_whole_tokenizers(monkeypatch):
    tokenizer = tokens.PieceTokenizer(tokenizer_file(VOCABULARY))
    assert tokenizer.split
    texts = odd_texts(random.Random(3), 6000)
    want = [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    monkeypatch.setattr(tokens, "RUN_BYTES", 3000)
    for split in (True, False):
        tokenizer.split = split
        got = [ids[a:b].tolist() for ids, bounds in tokenizer.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == want


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 300)
    rng = random.Random(2)
    rows = [(i * 3, t, "x", "y") for i, t in enumerate(odd_texts(rng, 300))]
    rows += [(None, "no id", "", ""), (None, None, "", ""), (7, None, "", ""), (8, "", "", ""), (9, "word " * 5000, "", ""), (2**62, "far", "", ""), (12, "twin", "", ""), (12, "twin", "", ""), (12, "twin 2", "", "")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    path = f"file://{tmp_path}/ids"
    manifest = tokens.write_token_files(docs, tokenizer_file(VOCABULARY), path).collect()
    got = tokens.read_files(spark, path, with_ids=True).collect()
    whole = tokens.PieceTokenizer(tokenizer_file(VOCABULARY)).tokenizer
    coded = [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows]
    assert Counter((r.doc_id, tuple(r.ids), r.ids_crc32, r.n_tokens) for r in got) == Counter((d, tuple(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids)) for d, ids in coded)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]))
    assert [(r.doc_id is not None, r.doc_id) for r in ordered] == sorted(((d is not None, d) for d, _ in coded), key=lambda x: (x[0], x[1] or 0))
    assert sum(m.n_tokens for m in manifest) == sum(len(ids) for _, ids in coded) and sum(m.n_docs for m in manifest) == len(rows)
    # The most frequent id has rank 0 in the file, and a task's file that is in no manifest is not read.
    data = open(f"{tmp_path}/ids/{manifest[0].file}", "rb").read()
    counts = Counter(i for _, ids in coded for i in ids)
    assert int(np.frombuffer(data, "<u4", 1, 16)[0]) == min(counts, key=lambda i: (-counts[i], i))
    (tmp_path / "ids" / "ids-000000-again.bin").write_bytes(data)
    assert tokens.read_files(spark, path).count() == len(rows)
    (tmp_path / "ids" / manifest[0].file).write_bytes(data[:-3])
    with pytest.raises(Exception, match="ends early"):
        tokens.read_files(spark, path).collect()


def test_token_files_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert tokens.write_token_files(spark.createDataFrame([], DOCS), tokenizer_file(VOCABULARY), path).count() == 0
    assert tokens.read_files(spark, path).count() == 0


# Lexical search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, queries, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    coded = [(d, Counter(terms(t))) for d, t, *_ in docs]
    n_docs, n_terms = sum(bool(c) for _, c in coded), sum(sum(c.values()) for _, c in coded)
    df = Counter(t for _, c in coded for t in c)
    asked = {}
    for q, t in queries:
        asked.setdefault(q, Counter()).update(terms(t))
    out = set()
    for q, wanted in asked.items():
        scores = []
        for d, c in coded:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in wanted.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out |= {(q, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])}
    return out


def test_search(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "The", "of", "é", "ÉA", "x1", "日本", "a_b", "w"] + [f"w{i}" for i in range(200)]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", ", ", "\n", "-", "\x7f")) for _ in range(n))
    docs = [(i, text(rng.choice((0, 1, 3, 30, 200))), "", "") for i in range(400)]
    docs += [(500 + i, "the rare1 twin", "", "") for i in range(30)] + [(None, "the rare1 twin", "", ""), (None, None, "", ""), (700, "", "", ""), (701, " ,.", "", ""), docs[3], docs[3], (702, text(20_000), "", ""), (2**60, "rare2", "", "")]
    queries = [(q, text(rng.choice((1, 5, 40)))) for q in range(25)] + [(30, "rare1 THE"), (31, None), (32, ""), (33, "nowhere"), (34, "rare2 rare2"), (35, "w1"), (35, "w2 w1"), (None, "rare2")]
    rng.shuffle(docs)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 3000)
    d = spark.createDataFrame(docs, DOCS).repartition(6)
    q = spark.createDataFrame(queries, "item_id long, text string").withColumns({"rank": F.lit("x"), "TERMS": F.lit("y")})
    want = plain_search(docs, queries, 10)
    for block in (200_000, 40):
        monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
        got = lexical.search(d, q).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want
    assert set(map(tuple, lexical.search(d, q, k=3).collect())) == plain_search(docs, queries, 3)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_ties_at_the_last_place():
    scores, ids = np.array([5, 9, 5, 5, 0, 7, 5]), np.array([40, 1, 10, 30, 5, 2, 20])
    none = np.array([False] * 6 + [True])
    assert ids[lexical.best(scores, ids, none, 4)].tolist() == [1, 2, 10, 30] and ids[lexical.best(scores, ids, none, 9)].tolist() == [1, 2, 10, 30, 40, 20]
