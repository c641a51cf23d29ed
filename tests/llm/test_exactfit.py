"""Packing by exact complements: whole, gapless, as the tokenizers library encodes, and near the fewest sequences."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from barloom.llm import exactfit, packing, queries

SCHEMA = "doc_id long, text string, length string, part int"


def fewest(sizes, length):
    """The least number of sequences, by trying every way to fill the next one."""

    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)

        def fill(room, start, rest):
            nonlocal best
            best = min(best, 1 + least(rest))
            for i in range(start, len(rest)):
                if rest[i] <= room:
                    fill(room - rest[i], i, rest[:i] + rest[i + 1 :])

        fill(length - first, 0, rest)
        return best

    return least(tuple(sorted(sizes, reverse=True)))


def check_plan(counts, patterns):
    length = len(counts) - 1
    got = Counter()
    for times, used in patterns:
        assert times > 0 and sum(a * n for a, n in used.items()) <= length
        for a, n in used.items():
            got[a] += times * n
    assert got == Counter({a: int(n) for a, n in enumerate(counts) if n})
    return sum(t for t, _ in patterns)


@pytest.mark.parametrize("seed", range(30))
def test_plan_against_the_fewest(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 17, rng.integers(1, 10)).tolist()
    n = check_plan(np.bincount(sizes, minlength=17), exactfit.plan(np.bincount(sizes, minlength=17)))
    assert n <= fewest(sizes, 16) + (seed % 10 == 9)  # the fewest, but for a rare extra one


@pytest.mark.parametrize("seed", range(4))
def test_large_plans_are_short_and_nearly_full(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    counts[1:] = rng.integers(0, 10 ** rng.integers(1, 7), 2048)
    patterns = exactfit.plan(counts)
    check_plan(counts, patterns)
    assert len(patterns) < 10_000
    few = rng.integers(0, 30, 2049) * (np.arange(2049) > 0)  # even counts are the tightest case: no worse than best fit decreasing
    assert check_plan(few, exactfit.plan(few)) <= 1.0005 * (packing.best_fit(np.repeat(np.arange(2049), few), 2048).max() + 1)
    counts[1025:] //= 10  # as in texts, shorter ones are more common
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert check_plan(counts, exactfit.plan(counts)) <= 1.0001 * least + 1


def test_exact_complements_come_first():
    counts = np.zeros(101, np.int64)
    counts[[60, 40, 25, 15, 10]] = 1  # 60 + 40, not 60 + 25 + 15
    assert exactfit.plan(counts)[0] == (1, {60: 1, 40: 1})
    counts = np.zeros(101, np.int64)
    counts[[70, 20, 10, 5, 25]] = 3
    assert exactfit.plan(counts)[0] == (3, {70: 1, 25: 1, 5: 1})  # a pair
    counts = np.zeros(101, np.int64)
    counts[[70, 14, 11, 5]] = 2
    assert exactfit.plan(counts)[0] == (2, {70: 1, 14: 1, 11: 1, 5: 1})  # a triple
    counts = np.zeros(101, np.int64)
    counts[[70, 10]] = [4, 12]
    assert exactfit.plan(counts) == [(4, {70: 1, 10: 3})]  # a single three times
    assert exactfit.plan(np.zeros(101, np.int64)) == []


def check_rows(rows, ids_of, length):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); ids_of: multiset of documents' ids by doc_id."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[3]))
        docs[r[0]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for i, texts in ids_of.items():
        got = Counter((r[1], r[2], r[3], r[4]) for r in docs[i])
        want = Counter()
        for ids in texts:
            first = len(ids) % length or min(len(ids), length)
            cuts = [0, *range(first, len(ids) + 1, length)]
            for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                want[k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
        assert got == want
    assert set(docs) == set(ids_of)
    return len(sequences), sum(map(len, (x for t in ids_of.values() for x in t)))


@pytest.mark.parametrize("length", [7, 64])
def test_pack_whole_table(spark, length):
    rng = np.random.default_rng(length)
    texts = [None, "", "a", "é" * 40, "x" * length, "x" * (length - 1), "y" * (3 * length - 1), "z" * 5000] + ["w" * int(n) for n in rng.integers(0, 2 * length, 300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", "", 2), (3, "again", "", 3), (3, "again", "", 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exactfit.pack(df, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append([*(t or "").encode(), packing.BYTES.end])
    n, total = check_rows(list(map(tuple, got)), ids, length)
    assert n <= -(-total // length) + 2


def test_sequences_hold_their_ids(spark):
    df = spark.createDataFrame([(i, "ab" * i, "", 0) for i in range(40)], SCHEMA)
    rows = exactfit.sequences(df, 32).collect()
    back = defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_tokens <= 32 and sum(s.length for s in r.segments) == len(ids)
        for s in r.segments:
            back[s.doc_id][s.piece] = ids[s.offset : s.offset + s.length].tolist()
    for i in range(40):
        assert sum((back[i][k] for k in sorted(back[i])), []) == [*("ab" * i).encode(), packing.BYTES.end]


def test_empty_table(spark):
    assert exactfit.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_the_tokenizers_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [[*t.encode(r.text or "", add_special_tokens=False).ids, 0]] for r in docs}
    got = queries.op12_best_fit(spark, sf).collect()
    n, total = check_rows(list(map(tuple, got)), ids, 2048)
    assert n <= -(-total // 2048) + 1


def test_ranks_give_the_library_s_ids():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = np.random.default_rng(0)
    alphabet = list("aAbz  \t\n\r.,'!<|>09éßñ漢字😀\u00a0\u200b\u0301İ_-") + ["'ll", "<|endoftext|>", "\x00", "   "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(3000)]
    flat, off = exactfit.public_vocabulary().ids(pa.array(texts))
    assert [flat[a:z].tolist() for a, z in zip(off, off[1:])] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
