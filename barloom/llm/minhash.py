"""MinHash near-dedup with b-bit signatures: candidates by bands, estimates by bit counts, exact confirmation.

A document's set holds its distinct shingles of k words (A-Z lowered); with fewer words, the whole sequence is
one shingle; without words it is empty and linked with nothing. Two documents are linked if the Jaccard
similarity of their full sets reaches the threshold.

1. One scan: set size, a 128-bit key of the set, 256 minima. Their low 4 bits are packed into 16 longs; bands of
   4 of the first 128 full minima are hashed to keys. At a similarity of 0.8, a pair shares none of 32 bands once in 20 million.
2. Equal sets become a class, represented by its smallest id; all that follows works on classes.
3. Within a band bucket, no list of all pairs is made. First every member is compared with the bucket's first one.
   Where a bucket then still holds more than one component, each member outside the first one's component looks
   among members of other components for those whose signatures come near enough, nearest first, inside the task that
   has their texts; once it is linked with a component, the rest of that one is passed over. Pairs inside a component
   can't change the result, so none that matters is left out, and only links come out. A large bucket is dealt over
   many tasks in tiles of seekers and members. What is known of a bucket as a whole comes from aggregates that combine
   before their shuffle; it is joined to the members of hot buckets by broadcast. Hot are buckets with more than 1 / HOT of all
   memberships, so there are fewer than HOT of them, and no task gets the members of one.
4. A pair is first estimated: the share of equal 4-bit values, corrected for chance collisions. Pairs more than six
   standard deviations below the threshold are dropped; the others are confirmed on full sets.
5. Components of the links by repeated minimum labels and shortcuts, as tables.

Nulls: a null text is empty; rows with a null id are linked with nothing, are kept, and have a null component.
Rows of one id count as one document with the links of all of them. Empty tables give empty tables. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

U = np.uint64
BANDS, ROWS, BITS = 32, 4, 4
HASHES = 256  # bands take the first BANDS * ROWS
#: Members outside the first component that one task compares with a bucket.
SEEKERS = 2048
DOCS = 1024  # texts whose sets are made at a time
#: Hot buckets have more than 1 / HOT of all memberships, and more than SMALL.
HOT, SMALL = 4096, 256
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_LOW = "1229782938247303441L"  # 0x1111...: one bit for each 4-bit value


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (54-bit hashes) of each text, and their bounds; at most DOCS texts."""
    core.give_back()
    n = len(off) - 1
    buf = core.lower(buf)
    s, e, at = core.words(buf, off)
    h = core.word_hashes(buf, s, e)
    count = np.diff(at)
    size = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(size))
    doc = np.repeat(np.arange(n), size)
    whole = core.ngrams(h, k)
    values = np.zeros(bounds[-1], np.uint64)
    long = count >= k
    pick = np.repeat(long, size)
    start = at[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    values[pick] = whole[start[pick]]
    for few in range(1, k):
        for i in np.flatnonzero(count == few):
            values[bounds[i]] = core.ngrams(h[at[i] : at[i + 1]], few)[0] ^ U(few)
    key = np.sort((doc.astype(np.uint64) << U(54)) | (values >> U(10)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & U((1 << 54) - 1), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U(54)) if n < DOCS else np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << U(54)), len(key))


def _minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima of 32-bit hashes; every text has a shingle."""
    x = (core.mix(values) >> U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    y = np.empty_like(x)
    for j in range(HASHES):
        np.multiply(x, _A[j], out=y)
        y += _B[j]
        out[:, j] = np.minimum.reduceat(y, bounds[:-1])
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """(texts, longs): 16 values of 4 bits each."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), -1, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * U(BITS)), axis=2).view(np.int64)


def _bands(minima: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        h = core.mix(h * core._R ^ minima[:, r : BANDS * ROWS : ROWS].astype(np.uint64)) if len(h) else h
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, lo, hi (key of the set), sig and bands array<long>; one scan, no shuffle."""
    core.bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            n = len(b)
            size, key = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            sig, bands = np.zeros((n, HASHES * BITS // 64), np.int64), np.zeros((n, BANDS), np.int64)
            for a in range(0, n, DOCS):
                part = b.column(0).slice(a, DOCS)
                values, bounds = shingle_sets(*core.flat(part), k)
                m = np.diff(bounds)
                size[a : a + len(part)] = m
                full = np.flatnonzero(m)
                if len(full):
                    starts = np.append(bounds[:-1][full], len(values))
                    minima = _minima(values, starts)
                    mixed = core.mix(values ^ U(0x5851F42D4C957F2D))
                    key[a + full, 0] = np.add.reduceat(mixed, starts[:-1])
                    key[a + full, 1] = np.bitwise_xor.reduceat(core.mix(mixed), starts[:-1])
                    sig[a + full], bands[a + full] = _packed(minima), _bands(minima)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), pa.array(size), pa.array(key[:, 0].view(np.int64)), pa.array(key[:, 1].view(np.int64)), lists(sig), lists(bands)], names=["doc_id", "n_shingles", "lo", "hi", "sig", "bands"])

    return docs.select(text, id_col).mapInArrow(run, "doc_id long, n_shingles long, lo long, hi long, sig array<long>, bands array<long>")


def estimate(a: str, b: str):
    """Similarity from two packed signatures: equal values counted by bits, less those equal by chance."""
    x = f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, z) -> n + bit_count(~(z | shiftrightunsigned(z, 1) | shiftrightunsigned(z, 2) | shiftrightunsigned(z, 3)) & {_LOW}))"
    return (F.expr(x) / HASHES - 1 / 2**BITS) / (1 - 1 / 2**BITS)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def spread(rows: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """rows, of one row a key, with a column salt from 0 to below copies: those of the few keys that copies (key, copies) has stand so often."""
    many = rows.join(F.broadcast(copies.withColumnRenamed("key", key)), key, "left")
    return many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")


def salted(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """pairs (a, b) with the copy of b that a's hash picks, so that no b that many share meets them all in one task."""
    many = pairs.join(F.broadcast(copies.withColumnRenamed("key", "b")), "b", "left")
    return many.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"))


def confirm(pairs: DataFrame, texts: DataFrame, copies: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b, salt) with 100 * intersection >= percent * union of their full sets; texts has (id, text)."""
    other = spread(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), copies, "b")
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(other, ["b", "salt"]).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = np.zeros(len(batch), bool)
            for lo in range(0, len(batch), 256):
                hi = min(lo + 256, len(batch))
                va, ba = shingle_sets(*core.flat(batch.column(2).slice(lo, hi - lo)), k)
                heads = [i for i in range(lo, hi) if i == lo or b[i] != b[i - 1] or a[i] == a[i - 1]]  # the same pair again: a repeated id, maybe of another text
                vb, bb = shingle_sets(*core.flat(batch.column(3).take(pa.array(heads))), k)
                j = -1
                for i in range(lo, hi):
                    if j + 1 < len(heads) and heads[j + 1] == i:
                        j += 1
                    good[i] = _linked(va[ba[i - lo] : ba[i - lo + 1]], vb[bb[j] : bb[j + 1]], percent)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of links (a, b). Minimum labels and shortcuts, a table a round."""
    both = core.written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    label = core.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = core.written(step.join(up, "root", "left").select("node", "old", F.coalesce(F.least("up", "root"), "root").alias("root")), "labels")
        core.dropped(label)
        label = new
        if new.where("old <> root").limit(1).count() == 0:
            core.dropped(both)
            out = new.select("node", "root")
            out.written_path = new.written_path
            return out


def of_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the columns of facts, which has a row a bucket, for those buckets that facts has. Both have (bucket, hot)."""
    cold = rows.where("not hot").join(facts.where("not hot").drop("hot"), "bucket")
    return cold.unionByName(rows.where("hot").join(F.broadcast(facts.where("hot").drop("hot")), "bucket"))


def settle(rows: DataFrame, texts: DataFrame, floor: float, k: int, percent: int, task_bytes: int = 8 << 20) -> DataFrame:
    """Links (a, b) between members of buckets that lie in different components: all that a seeker has whose estimate reaches floor,
    but for those into a component that it is linked with already. rows: (bucket, hot, rep, root, main, sig, bands); a pair is looked
    at in the first of its common bands."""
    away = F.col("root") != F.col("main")
    tiles = rows.groupBy("bucket").agg(F.any_value("hot").alias("hot"), F.ceil(F.count(F.when(away, 1)) / SEEKERS).cast("int").alias("ns"), F.ceil(F.count("*") / (2 * SEEKERS)).cast("int").alias("nm"))
    rows = of_bucket(rows, tiles.where("ns > 0")).join(texts.select(F.col("id").alias("rep"), "text"), "rep").select("bucket", "rep", "root", "sig", "bands", "text", "ns", "nm", away.alias("away"))
    mine = rows.where("away").select("*", F.lit(True).alias("own"), F.pmod(F.xxhash64("rep"), F.col("ns")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"))
    every = rows.select("*", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nm")).cast("int").alias("j"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text") * (F.col("ns") + F.when(F.col("away"), F.col("nm")).otherwise(0)))).first()[0] or 0) // task_bytes))
    dealt = mine.unionByName(every).select(F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(n)).cast("int").alias("shard"), "bucket", "i", "j", "rep", "root", "own", "sig", "bands", "text")
    least = int(np.ceil((floor * (1 - 1 / 2**BITS) + 1 / 2**BITS) * HASHES))

    def run(t: pa.Table) -> pa.Table:
        bucket, i, j, rep, root, own = (t[c].to_numpy() for c in ("bucket", "i", "j", "rep", "root", "own"))
        matrix = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rep), -1)
        sig, bands = matrix("sig"), matrix("bands")
        text = t["text"].combine_chunks()
        _, head, which = np.unique(rep, return_index=True, return_inverse=True)
        sets = []
        for a in range(0, len(head), DOCS):
            values, bounds = shingle_sets(*core.flat(text.take(pa.array(head[a : a + DOCS]))), k)
            sets += [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        order = np.lexsort((j, i, bucket))
        b = np.stack([bucket[order], i[order], j[order]])
        cuts = np.flatnonzero(np.concatenate([[True], (b[:, 1:] != b[:, :-1]).any(axis=0), [True]]))
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            tile = order[lo:hi]
            seekers, members = tile[own[tile]], tile[~own[tile]]
            for s in seekers.tolist():
                z = sig[members] ^ sig[s]
                z |= z >> U(2)
                z |= z >> U(1)
                same = HASHES - np.bitwise_count(z & U(0x1111111111111111)).sum(axis=1, dtype=np.int32)
                near = np.flatnonzero((same >= least) & (root[members] != root[s]))
                if not len(near):
                    continue
                common = bands[members[near]] == bands[s]
                near = near[bands[s][common.argmax(axis=1)].view(np.int64) == bucket[s]]
                x, met = sets[which[s]], set()
                for m in members[near[np.argsort(-same[near], kind="stable")]].tolist():
                    if int(root[m]) not in met and _linked(x, sets[which[m]], percent):
                        met.add(int(root[m]))
                        found.append((max(rep[s], rep[m]), min(rep[s], rep[m])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return dealt.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that can be reached by links, itself included), kept: one row per row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = core.written(signatures(docs, k), "signatures")
    key = ["lo", "hi", "n_shingles"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = core.written(usable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    most = max(SMALL, classes.count() * BANDS // HOT)
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
    firsts = core.written(shared.select("bucket", "first", "n", (F.col("n") > most).alias("hot")), "buckets")
    # fewer than HOT of these, and all their copies are fewer than 2 * HOT: no copy meets more pairs than a bucket that isn't hot has members
    copies = core.written(firsts.where("hot").groupBy(F.col("first").alias("key")).agg(F.ceil(F.sum("n") / most).cast("int").alias("copies")), "copies")
    hot = F.broadcast(firsts.where("hot").select("bucket", F.lit(True).alias("hot")))
    marked = placed.join(hot, "bucket", "left").select("bucket", "rep", F.coalesce("hot", F.lit(False)).alias("hot"))
    members = core.written(of_bucket(marked, firsts.drop("n")), "members")
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = core.written(docs.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "candidates")
    sigs = classes.select("rep", "sig", "bands")
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    floor = percent / 100 - 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 1 / 2**BITS)
    pairs = core.written(members.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    known = spread(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), copies, "b")
    guess = salted(pairs, copies).join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(known, ["b", "salt"]).where(estimate("x", "y") >= floor)
    links = core.written(confirm(guess.select("a", "b", "salt"), texts, copies, k, percent), "links")
    core.dropped(firsts, pairs, copies)
    near = components(links)
    label = near.withColumnRenamed("node", "rep")
    rows = core.written(members.join(label, "rep", "left").select("bucket", "hot", "rep", "first", F.coalesce("root", "rep").alias("root")), "rooted")
    core.dropped(members, near)
    known = rows.groupBy("bucket").agg(F.any_value("hot").alias("hot"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.when(F.col("rep") == F.col("first"), F.col("root"))).alias("main"))
    apart = of_bucket(rows, known.where("lo <> hi").select("bucket", "hot", "main"))
    open_ = core.written(apart.join(sigs, "rep").select("bucket", "hot", "rep", "root", "main", "sig", "bands"), "open")
    more = core.written(settle(open_, texts, floor, k, percent), "links")
    core.dropped(rows, open_, texts)
    label = components(links.unionByName(more)).withColumnRenamed("node", "rep")
    core.dropped(links, more)
    named = classes.select(*key, "rep").join(label, "rep", "left").select(*key, F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", *key).join(named, key, "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), root).alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
