"""Katz scores against a plain model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from barloom.llm import core, katz, langid, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K = katz.TOP


def toks(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


class Plain:
    """Counts by history (a tuple of tokens) and the recursion, as the definition has them."""

    def __init__(self, texts, order):
        self.order, self.cc = order, defaultdict(Counter)
        for t in texts:
            w = ["<s>", *toks(t)]
            for i in range(1, len(w)):
                for k in range(min(order, i + 1)):
                    self.cc[tuple(w[i - k : i])][w[i]] += 1
        self.c = self.cc[()]
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = [self.discount(Counter(r for h, x in self.cc.items() if len(h) == k for r in x.values())) for k in range(order)]
        left = self.n - sum(self.d[0](c) * c for c in self.c.values())
        self.total, self.unseen = (self.n, left / self.n) if left > 1e-12 else (self.n + 1, 1 / (self.n + 1))
        self.cache = {}

    @staticmethod
    def discount(n):
        ok = all(n[r] for r in range(1, K + 2))
        last = (K + 1) * n[K + 1] / n[1] if ok else 2

        def d(r):
            if r > K:
                return 1.0
            x = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if last < 1 else -1
            return x if 0 < x < 1 else (r - 0.5) / r

        return d

    def p(self, h, w):
        if not h:
            c = self.c[w]
            return self.d[0](c) * c / self.total if c else self.unseen
        if not self.cc.get(h):
            return self.p(h[1:], w)
        x, d = self.cc[h], self.d[len(h)]
        if h not in self.cache:
            count, kept = sum(x.values()), sum(d(r) * r for r in x.values())
            div, left = (count + 1, 1) if all(r > K for r in x.values()) else (count, count - kept)
            self.cache[h] = div, left / div / (1 - sum(self.p(h[1:], y) for y in x))
        div, a = self.cache[h]
        r = x.get(w, 0)
        return d(r) * r / div if r else a * self.p(h[1:], w)

    def score(self, text):
        w = ["<s>", *toks(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i])) for i in range(1, len(w)))


@pytest.mark.parametrize("order, share", [(1, 1 << 20), (2, 3), (3, 1 << 20), (3, 3), (4, 5)])
def test_scores_equal_plain_model(spark, sf, order, share):
    """share 3: nearly every history is spread over several buckets."""
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "never_seen words_here"), (None, "The the THE"), (-4, "the " * 40)], "doc_id long, text string"))
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    m = Plain([r.text for r in rows if not held(r.doc_id)], order)
    for h in [h for h in m.cc if len(h) == order - 1][:30]:
        assert abs(sum(m.p(h, w) for w in m.c) + m.p(h, "no such") - 1) < 1e-9
    got = {r.doc_id: r for r in katz.score(docs, lambda c: ~langid.held_out("doc_id", 7), order, blocks=5, share=share).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, w = got[r.doc_id], toks(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(w), sum(m.c[x] > 0 for x in w), m.n)
        assert abs(g.base_score - sum(math.log10((m.c[x] + 1) / (m.n + m.v + 1)) for x in w)) < 1e-6
        assert abs(g.score - m.score(r.text)) < 1e-6 * max(1, len(w)), (r.doc_id, g.score, m.score(r.text))
    out = [g for g in got.values() if g.held_out and g.n_tokens > 20]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_messages_by_relays_give_the_same(spark, sf, monkeypatch, tmp_path):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    at = lambda: sorted(tuple(r) for r in katz.score(docs, lambda c: ~langid.held_out("doc_id", 7), 3, blocks=7, share=5).collect())
    tables = lambda path: [sorted(map(str, t.collect())) for t in katz.model_tables(docs, f"file://{tmp_path}/{path}", blocks=7, share=50)]
    want, model = at(), tables("direct")
    monkeypatch.setattr(core, "RELAY", 1)
    assert at() == want and tables("relayed") == model


def test_no_training_rows_and_empty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens, r.base_score, r.score) for r in katz.score(df, lambda c: F.lit(False)).collect()} == {(1, 3, 0.0, 0.0), (2, 1, 0.0, 0.0)}
    assert katz.score(df.limit(0)).count() == 0
    assert katz.score(spark.createDataFrame([(1, "a a a")], "doc_id long, text string")).first().score < 0


def test_tables_hold_the_model(spark, sf, tmp_path):
    """The tables alone give the counts of every order, and of each history what its weights are made of."""
    docs = queries.table(spark, sf, "documents").select("doc_id", "text")
    m = Plain([r.text for r in docs.collect()], 3)
    grams, histories = katz.model_tables(docs, f"file://{tmp_path}/model", blocks=5, share=50)
    rows = grams.collect()
    name = {r.ids[0]: r.hash for r in rows if r.order == 1}
    assert len(name) == m.v + 1 == len(set(name.values()))
    begin = int(katz.BEGIN) - (1 << 64)
    # tokens by their count profile: a bijection of names isn't needed to compare the multisets of counts of every history
    for k in (1, 2, 3):
        want = sorted(r for h, x in m.cc.items() if len(h) == k - 1 for r in x.values())
        assert sorted(r["count"] for r in rows if r.order == k and (k > 1 or r.hash != begin)) == want
    by = defaultdict(Counter)
    for r in rows:
        if r.order > 1:
            by[tuple(r.ids[:-1])][r.ids[-1]] += r["count"]
    shape = lambda x: (sum(x.values()), tuple(sorted(x.values())))
    assert Counter(shape(x) for x in by.values()) == Counter(shape(x) for h, x in m.cc.items() if h)
    lower = {tuple(r.ids): r["count"] for r in rows}
    sums = defaultdict(lambda: [0] * 12)
    for r in histories.collect():
        sums[tuple(r.ids)] = [a + b for a, b in zip(sums[tuple(r.ids)], r.sums)]
    assert set(sums) == set(by)
    for h, x in by.items():
        cs = [lower[(*h[1:], w)] for w in x]
        told = lambda rs: [sum(r == k for r in rs) for k in range(1, K + 1)] + [sum(r for r in rs if r > K)]
        assert sums[h] == told(list(x.values())) + told(cs)
