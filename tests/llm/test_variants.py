"""Spelling variants against all pairs of words, and the query against its SQL."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from barloom.llm import core, queries, variants

SCHEMA = "doc_id long, text string, word string, n int"
RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    out = Counter()
    for i, t in docs:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def plain(n):
    out = {}
    for w in n:
        others = [x for x in n if x != w and near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(others))
    rows = set()
    for w, (form, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, k, m, n[form] if form else None))
    return rows


def invented(seed, words=40, letters="abé"):
    """Few letters, so that near words and runs of equal letters are common."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(letters), rng.integers(6, 12))) for _ in range(words)]
    docs = [None, "", "short", "×÷ab÷×ÀÿÀÿ ŸŸŸŸŸŸŸŸ abc漢abcdefgh", "AAAAAAAA aaaaaaaa aaaaaaaaa Aaaaaaaaaa É" * 2]
    for _ in range(60):
        text = []
        for _ in range(rng.integers(1, 60)):
            w = base[int(rng.integers(0, len(base)) * rng.random() ** 2)]
            if rng.random() < 0.1:
                i = int(rng.integers(0, len(w)))
                w = w[:i] + str(rng.choice(["", *letters])) + w[i + int(rng.integers(0, 2)) :]
            text.append(w.upper() if rng.random() < 0.05 else w)
        docs.append(str(rng.choice([" ", "-", "\n", "1"])).join(text))
    return [(i, t) for i, t in enumerate(docs)] + [(None, base[0] + " " + base[1]), (None, base[0]), (5, docs[5])]


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_all_pairs(spark, seed):
    docs = invented(seed)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA).repartition(4)
    got = [tuple(r) for r in variants.group(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(counted(docs))


@pytest.mark.parametrize("bucket,hot", [(1, 10**9), (50, 10**9), (1, 4), (10**6, 1)])
def test_hot_halves_and_small_buckets_give_the_same(spark, bucket, hot):
    rng = np.random.default_rng(3)
    # a third of all words share their first half, another third their second half
    tail = lambda: "".join(rng.choice(list("abcd"), 5))
    n = {w: int(rng.integers(2, 500)) for w in {*("prefi" + tail() for _ in range(60)), *(tail() + "suffix" for _ in range(60)), *("".join(rng.choice(list("xy"), rng.integers(7, 11))) for _ in range(60))}}
    df = core.written(spark.createDataFrame([(bytearray(w.encode("latin-1")), k) for w, k in n.items()], "word binary, n long"), "test-words")
    got = {(bytes(r.word).decode("latin-1"), r.n, r.n_near, r.best and bytes(r.best).decode("latin-1")) for r in variants.near(df, bucket=bucket, hot=hot).collect()}
    assert got == {(w, k, sum(near(w, x) for x in n), min((x for x in n if near(w, x)), key=lambda x: (-n[x], x), default=None)) for w, k in n.items()}


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        v = rng.permutation(n)
        tree = variants.Wavelet(v)
        box = np.sort(rng.integers(0, n + 1, (200, 4)).reshape(200, 2, 2), axis=2)
        rect, value = tree.report(box[:, 0, 0], box[:, 0, 1], box[:, 1, 0], box[:, 1, 1])
        want = {(k, x) for k, ((l, r), (a, b)) in enumerate(box.tolist()) for x in v[l:r].tolist() if a <= x < b}
        assert len(rect) == len(want) and set(zip(rect.tolist(), value.tolist())) == want


def test_chains_of_forms(spark):
    """Each has ten times the count of the one before; roots are the last."""
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    n = {w: 2 * 10**k for k, w in enumerate(chain)}
    rows = core.written(spark.createDataFrame([(bytearray(w.encode()), bytearray(chain[k + 1].encode())) for k, w in enumerate(chain[:-1])], "word binary, form binary"), "test-forms")
    assert {bytes(r.word): bytes(r.root) for r in variants.roots(rows).collect()} == {w.encode(): chain[-1].encode() for w in chain[:-1]}
    assert plain(n) == {(w, chain[k + 1] if k < 4 else None, chain[-1], n[w], sum(near(w, x) for x in n), n[chain[k + 1]] if k < 4 else None) for k, w in enumerate(chain)}


def test_empty_tables_and_long_words(spark):
    assert variants.group(spark.createDataFrame([], SCHEMA)).collect() == []
    w = "a" * 3000
    docs = [(i, t) for i, t in enumerate([w + " " + w + "b"] * 3 + [w[:1000] + "z" + w[1000:]] * 3)]
    got = {tuple(r) for r in variants.group(spark.createDataFrame([(i, t, "", 0) for i, t in docs], SCHEMA)).collect()}
    assert got == plain(counted(docs))


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = c.execute(queries.SQL["op13_spelling_variants"])
    names = [d[0] for d in cur.description]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(cur.fetchall(), key=key)
    assert want and sorted((tuple(r) for r in queries.op13_spelling_variants(spark, sf).select(*names).collect()), key=key) == want
