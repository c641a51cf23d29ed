"""Benchmark decontamination: SimHash windows of an item's size, a multi-index, exact weighted similarity.

Words are runs of bytes other than ASCII marks and white space, A-Z lowered; shingles are 5 words. A document of
fewer words is one shingle, its whole sequence. An item of fewer words is one shingle of its own length: windows of so many
words of a document match it if they are equal, so an item of a word or two matches every document that says it.

For each item of m words, every window of m words of a document that shares a shingle with it is fingerprinted:
the signs of the sums of its shingles' 128 hash bits, weighted by how often each occurs. (A window without a common
shingle has similarity 0, so leaving it out loses nothing.) Fingerprints of items are indexed by BLOCKS blocks of 16
bits. Of two fingerprints within RADIUS = BLOCKS * (NEAR + 1) - 1, some block differs in NEAR bits at most; so looking up
all values within NEAR bits of a window's block, in each block, finds all of them, and some 8 in 100 unrelated ones. What is
found is verified: the sum of the smaller weights over the sum of the larger ones must reach the threshold. Two texts
of similarity 0.8 differ in 19 of 128 bits on average, and in more than RADIUS about twice in a thousand; the nearer, the rarer.

The items go with the tasks, in groups of MAX_BYTES at most, one group at a time: with several, each takes a pass over
the documents, whose result is a table before the next group is read.

Nulls: a null text or item is empty and matches nothing; null ids are kept as they are. A document shorter than an
item is one window. Repeated rows give repeated results, repeated items a row each. Of equal windows the first is
told. Empty tables give empty tables. Extra columns are not read; `clean` carries all of them.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

U = np.uint64
K, THRESHOLD = 5, 0.8
BLOCKS, WIDTH, NEAR = 8, 16, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
MAX_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
_MARKS = np.zeros(256, bool)
_MARKS[:128] = True
for _a, _z in ((48, 58), (65, 91), (97, 123)):
    _MARKS[_a:_z] = False
#: What to change in a block to get all values within NEAR bits of it.
_CHANGES = np.array([sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(WIDTH), n)], np.uint16)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, index of each text's first)."""
    buf = core.lower(buf)
    s, e, at = core.words(buf, off, _MARKS)
    return core.word_hashes(buf, s, e), at


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, told apart by k where it is under K."""
    return core.ngrams(h, k) ^ U(k % K)


def shingles(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in order, index of each text's first)."""
    count = np.diff(at)
    size = np.maximum(count - K + 1, (count > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(size))
    full = runs(h, K)
    doc = np.repeat(np.arange(len(count)), size)
    out = np.zeros(bounds[-1], np.uint64)
    long = np.repeat(count >= K, size)
    out[long] = full[(at[:-1][doc] + np.arange(len(doc)) - bounds[:-1][doc])[long]]
    for few in range(1, K):
        for i in np.flatnonzero(count == few):
            out[bounds[i]] = runs(h[at[i] : at[i + 1]], few)[0]
    return out, bounds


def signs(h: np.ndarray) -> np.ndarray:
    """(shingles, 128): 1 where a hash bit is set, -1 where not."""
    both = np.stack([h, core.mix(h ^ U(0x2545F4914F6CDD1D))], axis=1)
    bits = np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """(texts, BLOCKS) blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


class Index:
    """Items by shingle, by length and by fingerprint block."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [(t or "").encode() for _, t in items]
        hashes, at = words(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        h, bounds = shingles(hashes, at)
        n = len(items)
        self.ids, self.words, self.size = [i for i, _ in items], np.diff(at), np.diff(bounds)
        self.own = [np.unique(h[a:z], return_counts=True) for a, z in zip(bounds[:-1], bounds[1:])]
        self.prints = np.zeros((n, BLOCKS), np.uint16)
        some = np.flatnonzero(self.size)
        for part in np.split(some, np.flatnonzero(np.diff(bounds[some] // 4096)) + 1):
            if len(part):
                a = bounds[part[0]]
                self.prints[part] = fingerprints(np.add.reduceat(signs(h[a : bounds[part[-1] + 1]]), bounds[part] - a))
        # of long items all shingles, of short ones the whole sequence by its length
        long = self.words >= K
        keys = np.concatenate([self.own[i][0] for i in np.flatnonzero(long)] + [h[:0]])
        of = np.repeat(np.flatnonzero(long), np.array([len(self.own[i][0]) for i in np.flatnonzero(long)], np.int64))
        order = np.lexsort((of, keys))
        self.keys, self.of = keys[order], of[order]
        self.some = np.zeros(1 << 22, bool)
        self.some[(self.keys >> U(42)).astype(np.int64)] = True
        self.short = {}
        for m in range(1, K):
            i = np.flatnonzero(self.words == m)
            i = i[np.argsort(h[bounds[i]], kind="stable")]
            if len(i):
                self.short[m] = h[bounds[i]], i
        self.tables = []
        for b in range(BLOCKS):
            order = np.flatnonzero(long)[np.argsort(self.prints[long, b], kind="stable")]
            self.tables.append((np.searchsorted(self.prints[order, b], np.arange((1 << WIDTH) + 1)), order))

    def near(self, prints: np.ndarray, items: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) of those items whose fingerprint is within RADIUS, by the blocks that are near."""
        column = np.full(len(self.ids), -1, np.int64)
        column[items] = np.arange(len(items))
        found = np.zeros((len(prints), len(items)), bool)
        for b, (start, order) in enumerate(self.tables):
            values, which = np.unique(prints[:, b], return_inverse=True)
            near = (values[:, None] ^ _CHANGES).astype(np.int64)
            v, c = np.nonzero(start[near] < start[near + 1])
            lo, count = start[near[v, c]], start[near[v, c] + 1] - start[near[v, c]]
            v = np.repeat(v, count)
            to = column[order[np.arange(len(v)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]]
            hit = np.zeros((len(values), len(items)), bool)
            hit[v[to >= 0], to[to >= 0]] = True
            found |= hit[which]
        w, c = np.nonzero(found)
        close = np.bitwise_count(prints[w] ^ self.prints[items[c]]).sum(axis=1) <= RADIUS
        return [(int(a), int(items[b])) for a, b in zip(w[close], c[close])]

    def similarity(self, window: np.ndarray, item: int) -> float:
        values, weight = self.own[item]
        at = np.minimum(np.searchsorted(values, window), len(values) - 1)
        got = np.bincount(at[values[at] == window], minlength=len(values))
        both = int(np.minimum(got, weight).sum())
        return both / (len(window) + int(weight.sum()) - both)

    def search(self, h: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item that one document, of these shingles, holds."""
        spot = np.flatnonzero(self.some[(h >> U(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[spot]), np.searchsorted(self.keys, h[spot], side="right")
        item = np.concatenate([self.of[a:z] for a, z in zip(lo, hi)]) if len(spot) else spot
        where = np.repeat(spot, hi - lo)
        best: dict[int, tuple[float, int]] = {}
        for size in np.unique(self.size[item]).tolist():
            mine = self.size[item] == size
            if len(h) <= size:
                starts = np.zeros(1, np.int64)
            else:
                # windows that hold a common shingle, found by a running count of the spots
                mark = np.zeros(len(h) + 1, np.int32)
                np.add.at(mark, np.maximum(where[mine] - size + 1, 0), 1)
                np.add.at(mark, where[mine] + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark[: len(h) - size + 1]) > 0)
                if not len(starts):
                    continue
            reach = min(size, len(h))
            for part in np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1):
                a, z = int(part[0]), int(part[-1]) + reach
                total = np.concatenate([np.zeros((1, 16 * BLOCKS), np.int32), np.cumsum(signs(h[a:z]), axis=0, dtype=np.int32)])
                prints = fingerprints(total[part - a + reach] - total[part - a])
                for w, i in self.near(prints, np.unique(item[mine])):
                    p = int(part[w])
                    s = self.similarity(h[p : p + reach], i)
                    if s >= threshold and (i not in best or (-s, p) < (-best[i][0], best[i][1])):
                        best[i] = s, p
        return [(i, s, p) for i, (s, p) in sorted(best.items())]

    def brief(self, h: np.ndarray, at: np.ndarray):
        """(text, item, 1.0, first word) of the first window that equals an item of fewer than K words."""
        for m, (keys, items) in self.short.items():
            got = runs(h, m)
            lo = np.searchsorted(keys, got)
            hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == got)
            text = np.searchsorted(at, hit, side="right") - 1
            inside = hit + m <= at[text + 1]
            hit, text = hit[inside], text[inside]
            new = np.unique(np.stack([text, lo[hit]], axis=1), axis=0, return_index=True)[1] if len(hit) else hit
            for t, p in zip(text[new].tolist(), hit[new].tolist()):
                for i in items[keys == got[p]].tolist():
                    yield t, i, 1.0, p - int(at[t])

    def rows(self, text: pa.Array, threshold: float):
        """(row, item, similarity, first word) for each document of a column."""
        buf, off = core.flat(text)
        cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, len(buf), SLICE_BYTES)), len(off) - 1))
        for a, z in zip(cuts[:-1], cuts[1:]):
            hashes, at = words(buf[off[a] : off[z]], off[a : z + 1] - off[a])
            h, bounds = shingles(hashes, at)
            hit = np.flatnonzero(self.some[(h >> U(42)).astype(np.int64)])
            for d in np.unique(np.searchsorted(bounds, hit, side="right") - 1).tolist():
                for i, s, p in self.search(h[bounds[d] : bounds[d + 1]], threshold):
                    yield a + d, i, s, p
            for d, i, s, p in self.brief(hashes, at):
                yield a + d, i, s, p


_last: tuple[str, Index | None] = "", None


def _index(name: str, items) -> Index:
    """The index of a group of items; a worker keeps the last one that it made."""
    global _last
    if _last[0] != name:
        _last = name, Index(items.value)
    return _last[1]


def groups(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", max_bytes: int = MAX_BYTES):
    """The number of groups of about max_bytes, then each group's items, read when it is asked for."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / max_bytes))
    yield n
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words (of the item): each item that a document holds, at its best window. One scan a group, no shuffle."""
    core.bound_batches(docs.sparkSession)
    out, every = None, groups(benchmark, max_bytes=max_bytes)
    n = next(every)
    for items in every:
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, name=name, shared=shared):
            ix = _index(name, shared)
            for b in batches:
                got = list(ix.rows(b.column(0), threshold))
                rows = [g[0] for g in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).cast(pa.int64()).take(pa.array(rows, pa.int64())), pa.array([ix.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()), pa.array([int(ix.words[g[1]]) for g in got], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "start_word", "n_words"],
                )

        part = docs.select(text, id_col).mapInArrow(run, MATCHES)
        if n > 1:
            part = core.written(part, "matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without the documents that hold an item; all columns, no shuffle. With several groups each pass writes what is left, and the table before it goes."""
    core.bound_batches(docs.sparkSession)
    before = None
    at = docs.columns.index(text)
    every = groups(benchmark, max_bytes=max_bytes)
    n = next(every)
    for items in every:
        name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, name=name, shared=shared):
            ix = _index(name, shared)
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[g[0] for g in ix.rows(b.column(at), threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = core.written(docs, "clean")
            shared.destroy()
            if before is not None:
                core.dropped(before)
            before = docs
    return docs
