"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

A word is a point: its rank among all words in forward order, and its rank in the order of the reversed words. Words with a
given prefix are an interval of the first order, words with a given suffix one of the second. Those that differ from w
at position i only are the points in the rectangle of w[:i] and w[i+1:] with w's length; those with one code point more there
are in the rectangle of w[:i] and w[i:]. A wavelet matrix over the reverse ranks, laid out in forward order, reports
the points of many rectangles at once, level by level. Of an insertion into a run of equal letters, the leftmost position counts.

The vocabulary grows with the corpus, so it is split. Words of length c, and those of c + 1 that one insertion makes of
them, meet in class c twice: at an edit in their second half by their first half, at an edit in the first half by their
second half. Halves are hashed to buckets of bounded size, each with its own trees. A half that more than 1 / HOT of all
memberships share (there are fewer than HOT such, so they are broadcast) is split by what is left around each position of an edit: no
more words than the alphabet has letters agree in that. So no bucket grows with one key, and each near pair is found exactly once.
A bucket gives one row for each of its words, with the number of near words and the best one: pairs never leave a task.

Letters are a-z, A-Z and U+00C0 to U+00FF, so a word is a row of Latin-1 bytes, and bytes have the order of code points.

Words are counted over all documents; counts combine before their shuffle. Nulls: a null text has no words, a null id counts as
an empty one in the hash. Rows that repeat count each. Ties of a form's count go to the smaller word. Very long words are words
like others. Texts without words, and empty tables, give no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

LEAST_LENGTH, LEAST_COUNT, FACTOR, DROPPED = 7, 2, 10, 31
#: Members of a bucket, on average.
BUCKET = 30_000
HOT = 4096
LATIN = "ISO-8859-1"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word binary, n long, n_near long, best_n long, best binary"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, dropped: int | None = DROPPED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word as Latin-1 bytes, n) of all whole texts. Every `dropped`-th run, by a hash of document and run, lacks a letter."""
    runs = F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}+"), F.lit(0))
    w = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("w")).withColumn("w", F.translate("w", UPPER, LOWER))
    if dropped:
        w = w.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w")))
        at = F.pmod(F.col("h"), F.length("w")).cast("int")
        w = w.withColumn("w", F.when(F.col("h") % dropped == 0, F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, F.length("w")))).otherwise(F.col("w"))).where(F.length("w") >= least_length)
    return w.groupBy(F.encode("w", LATIN).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Wavelet:
    """A wavelet matrix over a permutation: values in the order of their positions."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.levels = []
        v = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (v >> b & 1).astype(bool)
            zeros = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.levels.append(zeros)
            v = np.concatenate([v[~bit], v[bit]])

    def report(self, l: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each point at a position in [l, r) with a value in [a, b)."""
        rect = np.flatnonzero((l < r) & (a < b))
        l, r, low = l[rect], r[rect], np.zeros(len(rect), np.int64)
        for level, zeros in enumerate(self.levels):
            half = 1 << (self.bits - 1 - level)
            l0, r0, z = zeros[l], zeros[r], zeros[-1]
            left = np.flatnonzero((l0 < r0) & (a[rect] < low + half) & (b[rect] > low))
            l1, r1, high = l - l0 + z, r - r0 + z, low + half
            right = np.flatnonzero((l1 < r1) & (a[rect] < high + half) & (b[rect] > high))
            l, r = np.concatenate([l0[left], l1[right]]), np.concatenate([r0[left], r1[right]])
            low = np.concatenate([low[left], high[right]])
            rect = np.concatenate([rect[left], rect[right]])
        return rect, low


class Order:
    """Words sorted, and for each the interval of those that share its first i letters."""

    def __init__(self, rows: np.ndarray, marked: np.ndarray):
        """rows: (words, width) bytes, short words filled up with zeros; marked: words of the first kind, others are of the second."""
        n, width = rows.shape
        self.by_rank = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.by_rank] = np.arange(n)
        s = rows[self.by_rank]
        differ = s[1:] != s[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        kinds = marked[self.by_rank]
        self.before = [np.append(0, np.cumsum(kinds)), np.append(0, np.cumsum(~kinds))]

    def interval(self, words: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """[first, end) of the ranks that share the first i letters with each of the words."""
        starts = np.append(0, np.flatnonzero(self.common < i) + 1)
        at = np.searchsorted(starts, self.rank[words], "right")
        return starts[at - 1], np.append(starts, len(self.rank))[at]


def near_pairs(rows: np.ndarray, short: np.ndarray, replaced: range, inserted: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indexes (w, v) of words of the same length that differ at one of the positions `replaced` (each pair both ways), and
    (w, v) with v one letter longer, inserted at one of `inserted`.

    rows: distinct words as bytes, c of them in short ones and c + 1 in long ones, where short ones end in 0.
    """
    c = rows.shape[1] - 1
    back = np.zeros_like(rows)
    back[short, :c] = rows[short, :c][:, ::-1]
    back[~short] = rows[~short][:, ::-1]
    forward, reverse = Order(rows, short), Order(back, short)
    found = []
    for kind, positions in ((0, replaced), (1, inserted)):
        of_kind = short if kind == 0 else ~short
        # ranks among the words of this kind
        ids = reverse.by_rank[of_kind[reverse.by_rank]]
        within = np.empty(len(rows), np.int64)
        within[ids] = np.arange(len(ids))
        tree = Wavelet(within[forward.by_rank[of_kind[forward.by_rank]]])
        got = [], []
        asking = np.flatnonzero(short)
        for i in positions if len(ids) > (kind == 0) else ():
            l, r = (forward.before[kind][x] for x in forward.interval(asking, i))
            a, b = (reverse.before[kind][x] for x in reverse.interval(asking, c - 1 - i if kind == 0 else c - i))
            # a word is in its own rectangle of replacements
            live = np.flatnonzero((r - l > (kind == 0)) & (b - a > (kind == 0)))
            rect, value = tree.report(l[live], r[live], a[live], b[live])
            w, v = asking[live[rect]], ids[value]
            keep = w != v if kind == 0 else rows[v, i] != rows[w, i - 1] if i else np.ones(len(w), bool)
            got[0].append(w[keep])
            got[1].append(v[keep])
        found += [np.concatenate([np.zeros(0, np.int64), *x]) for x in got]
    return tuple(found)


def _best(n: np.ndarray, rank: np.ndarray, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word with near words: itself, their number, and the one with the largest n (the smallest in order of ties)."""
    order = np.lexsort((rank[other], -n[other], at))
    who, first, count = np.unique(at[order], return_index=True, return_counts=True)
    return who, count, other[order[first]]


def _bucket(t: pa.Table) -> pa.Table:
    """Rows of FOUND of a bucket's words; columns c, second_half, at (a position, or -1 for all of a half), kind, word, n."""
    keys = np.column_stack([t[x].to_numpy().astype(np.int64) for x in ("c", "second_half", "at", "kind")])
    n = t["n"].to_numpy()
    flat, off = core.flat(t["word"])
    out = []
    _, inverse = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(inverse.ravel(), kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(inverse.ravel()[order])) + 1) if len(order) else []:
        if len(rows) < 2:
            continue
        c, second, at, kind = keys[rows[0]].tolist()
        size = off[rows + 1] - off[rows]
        letters = np.zeros((len(rows), c + 1), np.uint8)
        for long in (0, 1):  # words of one length at a time
            of = np.flatnonzero(size == c + long)
            letters[of, : c + long] = flat[off[rows[of]][:, None] + np.arange(c + long)]
        half = c // 2
        positions = [range(half, c), range(half, c + 1)] if second else [range(half), range(half)]
        if at >= 0:
            positions = [range(at, at + 1) if kind == k else range(0) for k in (0, 1)]
        same, other, w, v = near_pairs(letters, size == c, *positions)
        rank = np.empty(len(rows), np.int64)
        rank[np.argsort(letters.view(f"S{c + 1}").ravel(), kind="stable")] = np.arange(len(rows))
        who, count, best = _best(n[rows], rank, np.concatenate([same, w, v]), np.concatenate([other, v, w]))
        out.append((rows[who], count, rows[best]))
    who, count, best = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    word = t["word"].combine_chunks()
    word = pa.concat_arrays(word.chunks) if isinstance(word, pa.ChunkedArray) else word
    return pa.table({"word": word.take(pa.array(who)), "n": pa.nulls(len(who), pa.int64()), "n_near": pa.array(count.astype(np.int64)), "best_n": pa.array(n[best]), "best": word.take(pa.array(best))})


def _part(c: str, start: Column | int, length: Column | int) -> Column:
    return F.substring(F.col(c), F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def memberships(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """(c, second_half, key, word, n): the classes and halves in which each word meets others, with a hash of the half that it shares."""
    size, c = F.octet_length("word"), F.col("c")
    m = vocabulary.withColumn("c", F.explode(F.array(size, size - 1))).where(c >= least_length)
    m = m.withColumn("second_half", F.explode(F.array(F.lit(True), F.lit(False))))
    half = (c / 2).cast("int")
    shared = F.when(F.col("second_half"), _part("word", 1, half)).otherwise(_part("word", size - (c - half) + 1, c - half))
    return m.withColumn("key", F.xxhash64("c", "second_half", shared))


def _refined(m: DataFrame) -> DataFrame:
    """Members of halves that are too common, by the letters around each position: kind 0 replaces, kind 1 inserts."""
    size, c, i = F.octet_length("word"), F.col("c"), F.col("at")
    half, short = (c / 2).cast("int"), size == c
    low, high = F.when(F.col("second_half"), half).otherwise(0), F.when(F.col("second_half"), c).otherwise(half - 1)
    m = m.withColumn("at", F.explode(F.sequence(low, high)))
    m = m.withColumn("kind", F.explode(F.when(short & (i < c), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    skipped = F.when(short & (F.col("kind") == 1), 0).otherwise(1)
    return m.withColumn("key", F.xxhash64("c", "second_half", "kind", "at", _part("word", 1, i), _part("word", i + 1 + skipped, size)))


def near(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Rows (word, n, n_near, best_n, best) of a written table (word as Latin-1 bytes, distinct; n)."""
    m = memberships(vocabulary, least_length)
    common = core.written(m.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > bucket), "halves")
    total = m.count()
    # fewer than `hot` keys
    common = F.broadcast(common.where(F.col("members") > max(bucket, total // hot)).select("key"))
    usual = m.join(common, "key", "left_anti").withColumns({"at": F.lit(-1), "kind": F.lit(0)})
    split = _refined(m.join(common, "key", "left_semi"))
    buckets = max(1, -(-total // bucket))
    all_ = usual.unionByName(split).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    found = all_.select("bucket", "c", "second_half", "at", "kind", "word", "n").groupBy("bucket").applyInArrow(_bucket, FOUND)
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("binary").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))).alias("b")
    rows = own.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    return rows.select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of written (word, form): forms followed to the last. A form has FACTOR times the count, so chains are short, and pointers double."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = core.written(at.join(step, "root", "left"), "roots")
        at = nxt.select("word", F.coalesce("further", "root").alias("root"))
        if nxt.where("further is not null").isEmpty():
            return at


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, dropped: int | None = DROPPED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near word of the largest count if that is `factor` times its own, and where such forms lead."""
    vocabulary = core.written(words(docs, least_length, least_count, dropped, id_col, text), "vocabulary")
    far = F.col("best_n") >= factor * F.col("n")
    rows = near(vocabulary, least_length).select("word", "n", "n_near", F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n"))
    rows = core.written(rows, "forms")
    led = roots(rows.where("form is not null").select("word", "form"))
    text_of = lambda c: F.decode(F.col(c), LATIN)
    out = rows.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select(text_of("word").alias("word"), text_of("form").alias("form"), text_of("root").alias("root"), "n", "n_near", "form_n")
