"""Exact and near duplicates and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sparkloom.llm import exact, jaccard, repeats

blocks = jaccard._block_links
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = prose(rng, 260)
    passage = prose(rng, 110)
    texts = [None, "", "  \n", "One", "one", "one two", "one  two three", base, base.upper(), base, "aB" * 3000, "ab" * 3000, "a" * 401, "a" * 900, "é" * 300 + "x", "é" * 300 + "y"]
    texts += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 40) for _ in range(4)]
    for edits in (0, 1, 2, 3, 5, 8, 12, 20):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts += [" ".join(words)] * (1 + edits % 2)
    line = "all rights reserved by the holders of this very common line of words"
    texts += [line + "\n" + prose(rng, rng.randrange(1, 60)) for _ in range(25)]
    texts.append(prose(rng, 5000))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return rows + [rows[7], (None, base, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_exact_groups(docs):
    rows = exact.exact_duplicates(docs, block=300).collect()
    norm = [((t or "").translate(LOWER), i) for i, t, *_ in corpus()]
    assert len(rows) == len(norm)
    by_hash = {}
    for t, i in norm:
        by_hash.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    kept = {}
    for r in rows:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert len({r.identity for r in rows}) == len(by_hash)
    assert {r.identity: r.text_sha256 for r in rows}.keys() == {r.identity for r in rows}
    left = exact.drop_exact_duplicates(docs, block=300)
    assert left.columns == docs.columns and left.count() == len(by_hash)


def test_exact_identity_does_not_depend_on_block_size(docs):
    groups = [{frozenset((r.rid) for r in g) for g in _by(exact.block_identities(docs, block=b).collect(), "identity")} for b in (1 << 20, 700)]
    assert groups[0] == groups[1]


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out.values()


def brute_sets(rows, size):
    out = {}
    for k, (i, t, *_) in enumerate(rows):
        w = WORD.findall((t or "").translate(LOWER))
        out[k] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
    return out


@pytest.mark.parametrize(("size", "percent", "options"), [(4, 85, {}), (5, 80, {"frequent": 2, "most": 3, "chunk_tokens": 2500}), (1, 30, {"frequent": 1, "most": 0, "chunk_tokens": 500})])
def test_near_duplicates(docs, size, percent, options):
    rows = corpus()
    sets = brute_sets(rows, size)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(b)] = root(a)
                    links += sets[a] != sets[b]
    least = {}
    for k in sets:
        i = rows[k][0]
        least[root(k)] = min((x for x in (least.get(root(k)), i) if x is not None), default=None)
    want = sorted(str((rows[k][0], len(sets[k]), least[root(k)] if sets[k] else rows[k][0])) for k in sets)
    got = jaccard.near_duplicates(docs, size=size, percent=percent, **options).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert links > 2


def test_near_duplicates_in_a_cluster_without_a_centre(spark):
    """Chains and clusters whose first member links with few of them, at every path of the verification."""
    rng, rows = random.Random(12), []
    for _ in range(6):
        words = prose(rng, 60, 10**6).split()
        for _ in range(40):
            for _ in range(rng.choice((1, 1, 1, 9))):
                words[rng.randrange(60)] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), None, None, None))
    rng.shuffle(rows)
    sets = brute_sets(rows, 2)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r[0]), r[0])
    want = {r[0]: least[root(k)] for k, r in enumerate(rows)}
    assert 6 < len(set(want.values())) < 100
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for options in ({"frequent": 8}, {"frequent": 1, "most": 2, "chunk_tokens": 700}):
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, size=2, **options).collect()} == want


def test_sets_that_share_a_few_common_tokens(spark, monkeypatch):
    """Buckets of pairs in which nobody links are told apart by longer combinations; few sets come to blocks."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(60)], 20)), None, None, None) for i in range(1200)]
    for i in range(0, 300, 3):  # and some that do link
        words = rows[i][1].split()
        words[rng.randrange(20)] = "new"
        rows.append((5000 + i, " ".join(words), None, None, None))
    sets = [frozenset(t.split()) for _, t, *_ in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = list(range(len(rows)))
    for a, b in links * 3:
        label[a] = label[b] = min(label[a], label[b])
    calls = []
    monkeypatch.setattr(jaccard, "_block_links", lambda members, *a: calls.append(members.select("node").distinct().count()) or blocks(members, *a))
    seen, keys = [], jaccard._keys
    monkeypatch.setattr(jaccard, "_keys", lambda ranked, percent, frequent, most, k=2: seen.append(k) or keys(ranked, percent, frequent, most, k))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), size=1, frequent=16).collect()
    assert {r.doc_id: r.component_id for r in got} == {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
    assert len(links) > 60 and seen == [2, 3, 4] and sum(calls) < 900


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_patterns_that_polynomial_hashes_confuse(spark):
    """Two strings that any polynomial modulo 2**64 takes for the same."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    first, second = jaccard.shingle_sets(pa.array([one, two]))
    assert not set(first) & set(second)
    rows = [(1, one, None, None, None), (2, two, None, None, None), (3, " ".join([one[:1024], two[:1024]] * 4), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3}
    depth, texts = 600, [t.encode() for _, t, *_ in rows]
    seen = {}
    for b in texts:
        for x in range(len(b) - depth + 1):
            seen[b[x : x + depth]] = seen.get(b[x : x + depth], 0) + 1
    for r in repeats.remove_repeats(docs, depth, with_text=True).collect():
        b, gone = texts[r.doc_id - 1], set()
        for x in range(len(b) - depth + 1):
            if seen[b[x : x + depth]] > 1:
                gone.update(range(x, x + depth))
        assert r.n_removed == len(gone)


def test_shingles_of_texts_in_a_row(monkeypatch):
    texts = [t for _, t, *_ in corpus()]
    alone = [next(jaccard.shingle_sets(pa.array([t], pa.string()))).tolist() for t in texts]
    assert [s.tolist() for s in jaccard.shingle_sets(pa.array(texts, pa.string()))] == alone
    assert [s.tolist() for s in jaccard.shingle_sets(pa.array(["x y", *texts, "z"], pa.large_string()).slice(1, len(texts)))] == alone
    want = brute_sets(corpus(), 4)
    assert [len(s) for s in alone] == [len(want[k]) for k in range(len(texts))]
    assert list(jaccard.shingle_sets(pa.array([], pa.string()))) == []


def test_large_ids_beside_null(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b c d e", None, None, None), (None, "a b c d e f", None, None, None)], SCHEMA).coalesce(1)
    for found in (exact.exact_duplicates(docs), jaccard.near_duplicates(docs), repeats.remove_repeats(docs)):
        assert {r.doc_id for r in found.collect()} == {2**60 + 1, None}


def test_short_sets_have_whole_identities(monkeypatch):
    """Where all tokens are the same 64 bits, texts of up to four words are still told apart."""
    monkeypatch.setattr(jaccard, "window_hashes", lambda words, size: np.zeros(len(words) - size + 1, np.uint64))
    texts = ["a b c d", "A  b c\nD ", "a b c", "a b c e", "x x x x", "x x x x x x", "ab c d", "a", None, ""]
    ids = [(h, l) for _, h, l in jaccard._identified(pa.array(texts), 4)]
    assert ids[0] == ids[1] and ids[4] == ids[5] and ids[8] == ids[9] and len(set(ids)) == 7


def test_near_duplicates_dropped(docs):
    left = jaccard.drop_near_duplicates(docs, size=5, percent=80)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(7) == 1 and 8 not in ids and None not in ids and {0, 1, 2} <= set(ids)


@pytest.mark.parametrize(("depth", "gram", "widths"), [(400, 128, (35, 5, 1)), (40, 8, (9, 1))])
def test_repeats(docs, depth, gram, widths):
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    seen = {}
    for _, b in texts:
        for x in range(len(b) - depth + 1):
            seen[b[x : x + depth]] = seen.get(b[x : x + depth], 0) + 1
    want = []
    for i, b in texts:
        gone = bytearray(len(b))
        for x in range(len(b) - depth + 1):
            if seen[b[x : x + depth]] > 1:
                gone[x : x + depth] = b"\1" * depth
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for x in range(len(gone)) if gone[x] and not (x and gone[x - 1]))
        want.append(str((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())))
    got = repeats.remove_repeats(docs, depth, gram, widths, with_text=True).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.spans) == r.n_removed for r in got)
    assert all(r.kept_chars == len(bytes(r.kept).decode(errors="ignore")) for r in got)


def test_shared_passages(spark, monkeypatch):
    rng = random.Random(8)
    short = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10)) for _ in range(n))
    passages = {n: short(n) for n in (49, 50, 51, 52, 59, 130)}
    texts = [None, "", short(50), short(51)]
    for passage in passages.values():
        texts += [f"{short(rng.randrange(70))} {passage} {short(40)}", f"{short(9)}\n{passage.replace(' ', '  ', 3)}\t{short(90)}"]
    twice = short(60)
    texts += [f"{twice} {short(5)} {twice}", passages[51], "the " * 90, "the " * 51, "the " * 50, f"{short(30)} {passages[52]} {twice[:-2]}", f"é {short(80)}"]
    texts += [f"{texts[-1]} {short(30)}", short(400)]
    texts.append(texts[-1][:300] + " edit " + texts[-1][300:])
    seen = {}
    words = [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for x in range(len(w) - 50):
            seen.setdefault(tuple(w[x : x + 51]), set()).add(i)
    want = [any(len(seen[tuple(w[x : x + 51])]) > 1 for x in range(len(w) - 50)) for w in words]
    assert 12 < sum(want) < len(want)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert [got[i].shared_passage for i in range(len(texts))] == want
    assert sum(got[i].shared_passage and not got[i].n_removed for i in got) >= 6  # under 400 bytes: marked and left
    batch = pd.DataFrame({"k1": range(len(texts)), "k2": 0, "text": [t or "" for t in texts]})
    windows = lambda: {(r.k1, r.a - d, r.a, r.core) for f in repeats._word_level0(iter([batch]), 51, 8) for r in f.itertuples() for d in range(r.lo, r.hi + 1)}
    whole = windows()
    assert {(i, x) for i, x, *_ in whole} == {(i, x) for i, w in enumerate(words) for x in range(len(w) - 50)}
    monkeypatch.setattr(repeats, "WORD_SEGMENT", 20)
    assert windows() == whole


def test_segments_of_long_texts(monkeypatch):
    import numpy as np

    data = np.random.default_rng(2).integers(97, 101, 3000, dtype=np.uint8)
    whole = [np.concatenate(x) for x in zip(*repeats.window_runs(data, 60, 12))]
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    parts = [np.concatenate(x) for x in zip(*repeats.window_runs(data, 60, 12))]
    starts = lambda r: sorted(a - d for a, lo, hi in zip(*r[:3]) for d in range(lo, hi + 1))
    anchors = lambda r: {(a - d, a) for a, lo, hi in zip(*r[:3]) for d in range(lo, hi + 1)}
    assert starts(whole) == list(range(len(data) - 59)) and anchors(whole) == anchors(parts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 3.5), (2, "A b c d e f", "y", None)], "doc_id long, text string, component string, n double")
    assert [r.doc_id for r in exact.drop_exact_duplicates(rows).collect()] == [2]
    assert [(r.doc_id, r.component, r.n) for r in jaccard.drop_near_duplicates(rows).collect()] == [(1, "x", 3.5)]
