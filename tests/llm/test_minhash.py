"""Near-duplicates against all pairs on full sets."""

import re

import numpy as np
import pytest

from barloom.llm import core, minhash, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    t = (text or "").encode()
    w = WORD.findall(t.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def copies(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = [None, "", " \t", "one", "One", "one two", "a b c", "A b\nc"]
    for _ in range(12):
        base = list(rng.choice(vocab, rng.integers(5, 120)))
        for _ in range(rng.integers(1, 12)):
            w = list(base)
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(0, len(w))] = str(rng.choice(vocab))
            docs.append(" ".join(w))
    chain = [f"c{i}" for i in range(400)]  # each links with the next only
    docs += [" ".join(chain[i * 10 : i * 10 + 100]) for i in range(20)]
    order = rng.permutation(len(docs))
    return [(int(p), docs[i]) for p, i in enumerate(order)]


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_all_pairs(spark, k):
    docs = copies(k)
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, sig string, n_shingles long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k).collect()}
    assert got == brute(docs, k, 80)


def test_tiles_and_near_misses(spark, monkeypatch):
    """A group around one text whose members are mostly no links of each other, dealt over many small tiles."""
    monkeypatch.setattr(minhash, "SEEKERS", 2)
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 12))):
            w[int(rng.integers(0, 200))] = f"x{int(rng.integers(0, 40))}"
        docs.append((i, " ".join(w)))
    want = brute(docs, 5, 80)
    assert 1 < len({c for _, c, _ in want.values()}) < 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == want


def test_query_equals_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op6_minhash_near_dedup(spark, sf).collect()} == brute(docs, 4, 80)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(2000)]
    a = words[:1000]
    rows = [(0, " ".join(a))] + [(i, " ".join(a[: 1000 - 60 * i] + words[1000 : 1000 + 60 * i])) for i in range(1, 8)]
    sig = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 1)
    first = sig.where("doc_id = 0").selectExpr("sig as x")
    for r in sig.crossJoin(first).select("doc_id", minhash.estimate("sig", "x").alias("e")).collect():
        same = 1000 - 60 * r.doc_id
        assert abs(r.e - same / (2000 - same)) < 0.2
