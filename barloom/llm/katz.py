"""Katz backoff scoring: Good-Turing discounted n-gram counts up to an order, exactly normalised backoff weights.

A text is its words `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end token; before its first token stands a begin token.
The history of a token is what stands before it, order - 1 tokens at most. With counts c of the training rows, Good-Turing
discounts d of each order (for counts up to 5; larger ones stay as they are), and h' for h without its first token:

    P(w)     = d c(w) / N              if w was seen; all that is left goes to one class of unseen tokens
    P(w | h) = d c(h w) / c(h)         if h w was seen
             = a(h) P(w | h')          if not; 1 P(w | h') for a history h never seen
    a(h)     = (1 - sum of P(w | h) over seen h w) / (1 - sum of P(w | h') over the same w)

so P(. | h) sums to 1 over all words, the end and the unseen class, at every order. A history whose counts are all above
5 has nothing left to give; its counts are then divided by c(h) + 1. Evaluation goes down this recursion for each token.

Counts are made in buckets. A block of documents sends each of its distinct n-grams once, with its own training count, and
gets the corpus count back in the order asked, so what a third of all rows holds costs one entry per block. Tokens are
told apart by 64-bit hashes; the bucket of a token gives it a number, small ones to frequent tokens, and n-grams are sent as these, packed.
The n-grams of a history share a bucket, but for those of histories with more than `share` occurrences, which are spread
over several by the next token: a block that has such a history asks all of these and adds up what they have. The bucket
also answers, for each history that may have to back off, how many of its continuations have each small count, here and
one order down; discounts and weights follow from these integers in the block. Blocks ask every bucket, and so get all counts of counts.

`model_tables` writes the counts and these sums as Parquet by order and bucket; the query holds the same buckets as
shuffle partitions, since writing and reading them adds about the size of the input to what is stored at once.

Nulls: a null text is empty and scores its end token; a null id is in training. Without training rows every
token has probability 1. Long texts are whole. Repeated rows count and score each. Empty tables give empty
tables. Extra columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .repeats import pack, unpack

U = np.uint64
ORDER = 3
TOP = 5  # counts up to this are discounted
BEGIN, END = U(0xB5026F5AA96619E9), U(0xD6E8FEB86659FD93)
#: Occurrences of a history that one bucket takes, at least, and buckets of one history, at most.
SHARE, SPREAD = 1 << 20, 4096
_SUMS = 2 * TOP + 2


def squeezed(batches):
    """Batches of (block, doc_id, text, training) with the text as compressed bytes, each with its size before it; a null is empty."""
    for b in batches:
        rows = [(x.as_py() or "").encode() for x in b.column(2)]
        data = [len(x).to_bytes(8, "little") + (pa.compress(x, "zstd", asbytes=True) if x else b"") for x in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary()), b.column(3)], names=["block", "doc_id", "text", "training"])


def unsqueezed(column) -> pa.ChunkedArray:
    rows = (x.as_py() for x in column)
    texts = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) if len(x) > 8 else b"" for x in rows]
    return pa.chunked_array([pa.array(texts, pa.large_binary())])


def tokens(text, training) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all tokens, each text's end token included; index of each text's first token; training flag of each token)."""
    core.give_back()
    buf, off = core.flat(text)
    buf = core.lower(buf)
    s, e, at = core.words(buf, off)
    n = len(off) - 1
    begins = at + np.arange(n + 1)
    h = np.empty(begins[-1], np.uint64)
    ends = begins[1:] - 1
    mask = np.ones(len(h), bool)
    mask[ends] = False
    h[mask] = core.word_hashes(buf, s, e)
    h[ends] = END
    return h, begins, np.repeat(training.combine_chunks().to_numpy(zero_copy_only=False).astype(bool) if n else np.zeros(0, bool), np.diff(begins))


def planes(x: np.ndarray) -> np.ndarray:
    """Integers from 0 on by bytes, all first ones first (high bytes are mostly zero), compressed."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.concatenate([np.array([len(x), width], "<i8").view(np.uint8), np.frombuffer(pa.compress(raw.tobytes(), "zstd", asbytes=True), np.uint8)])


def unplanes(b: np.ndarray) -> np.ndarray:
    n, width = b[:16].view("<i8").tolist()
    raw = np.frombuffer(pa.decompress(b[16:].tobytes(), width * n, "zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<i8").ravel()


def steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted tuples, by columns, as the steps of each column from one row to the next where those before it stay the same, else whole values."""
    out, turn = [], np.arange(len(columns[0])) == 0
    for x in columns:
        d = np.diff(x, prepend=0)
        out.append(np.where(turn, x, d))
        turn = turn | (d != 0)
    return out


def unsteps(columns: list[np.ndarray]) -> list[np.ndarray]:
    out, turn = [], np.arange(len(columns[0])) == 0
    for d in columns:
        total = np.cumsum(d)
        head = np.flatnonzero(turn)
        x = total - np.repeat((total - d)[head], np.diff(np.append(head, len(d))))
        out.append(x)
        turn = turn | (np.diff(x, prepend=0) != 0)
    return out


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of columns."""
    return functools.reduce(lambda a, y: core.mix(a * core._R ^ y.astype(np.uint64)), columns, np.zeros(len(columns[0]), np.uint64))


def by_bucket(bucket: np.ndarray, buckets: int):
    """(order by bucket, place of each entry in it, bounds of the buckets)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by counting
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank, np.searchsorted(bucket[order], np.arange(buckets + 1))


class _Level:
    """The distinct n-grams of a block at one order, by bucket and then by tokens: history (id one order down), token, that of the
    shorter n-gram without the first token, own training count; `of`: n-gram that ends at each token, -1 before the text has as many."""

    def __init__(self, history, token, low, own, of, names, lex, cuts, heads):
        self.history, self.token, self.low, self.own, self.of = history, token, low, own, of
        self.names, self.lex, self.cuts, self.heads = names, lex, cuts, heads
        self.count = self.flat = self.sums = self.wide = None


class _Block:
    """A block's n-grams, from the lowest order up; each order needs the answers on the one below."""

    def __init__(self, left: pa.Table, buckets: int, share: int):
        self.rows = left = core.ordered(left)
        self.buckets, self.share = buckets, share
        h, self.begins, self.training = tokens(unsqueezed(left["text"]), left["training"])
        self.place = np.arange(len(h), dtype=np.int32) - np.repeat(self.begins[:-1], np.diff(self.begins)).astype(np.int32)
        names, inverse = np.unique(np.append(h, BEGIN), return_inverse=True)
        del h
        order, rank, cuts = by_bucket((names % U(buckets)).astype(np.int32), buckets)
        names, inverse = names[order], rank[inverse]
        ids, begin = inverse[:-1], int(inverse[-1])
        own = np.bincount(ids[self.training], minlength=len(names))
        own[begin] = np.count_nonzero(self.training[self.begins[:-1]])
        every = np.arange(len(names), dtype=np.int32)
        self.levels = [None, _Level(None, every, None, own, ids, names, every, cuts, None)]
        self.begin, self.number, self.stats = begin, None, []

    def before(self, k: int):
        """(tokens that have a history of k - 1 tokens, the id of it)."""
        at = np.flatnonzero(self.place >= k - 2)
        if k == 2:
            v = np.full(len(at), self.begin, np.int32)
            inner = self.place[at] > 0
            v[inner] = self.levels[1].of[at[inner] - 1]
            return at, v
        return at, self.levels[k - 1].of[at - 1]

    def grow(self, k: int) -> _Level:
        below, one = self.levels[k - 1], self.levels[1]
        n, wide = U(len(one.names)), self.wide(k - 1)
        at, v = self.before(k)
        key = below.lex[v].astype(np.uint64)
        key *= n
        key += one.lex[one.of[at]].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        mine = np.empty(len(key), np.int32)
        mine[order] = np.cumsum(new, dtype=np.int32) - 1
        low = below.of[at[order[new]]]
        key = key[new]
        v, w = wide[(key // n).astype(np.int64)], self.wide(1)[(key % n).astype(np.int64)]
        own = np.bincount(mine[self.training[at]], minlength=len(v)).astype(np.int32)
        parts = np.minimum(below.count // self.share + 1, min(SPREAD, self.buckets)).astype(np.uint64)
        base = core.mix(below.names)
        bucket = ((base[v] + (core.mix(one.names[w]) >> U(20)) % parts[v]) % U(self.buckets)).astype(np.int32)
        order, rank, cuts = by_bucket(bucket, self.buckets)
        of = np.full(len(one.of), -1, np.int32)
        of[at] = rank[mine]
        names = core.mix(below.names[v[order]] * core._R ^ one.names[w[order]])
        # a history that is spread is asked for in all of its buckets, also where the block has no n-gram of it
        hot = np.unique(v[parts[v] > U(1)])
        spread = [((base[h] + np.arange(int(parts[h]), dtype=np.uint64)) % U(self.buckets)).astype(np.int64) for h in hot]
        where = np.concatenate([*spread, np.zeros(0, np.int64)])
        who = np.repeat(hot, [len(x) for x in spread]) if len(hot) else hot
        by, _, edges = by_bucket(where, self.buckets)
        heads = [who[by[edges[b] : edges[b + 1]]] for b in range(self.buckets)]
        self.levels.append(_Level(v[order], w[order], low[order], own[order], of, names, order, cuts, (parts > U(1), heads)))
        return self.levels[k]

    def heads(self, k: int, b: int):
        """What is asked of bucket b: (n-grams, their histories in order, n-grams of each, which of them are spread)."""
        level, below = self.levels[k], self.levels[k - 1]
        part = slice(level.cuts[b], level.cuts[b + 1])
        hot, extra = level.heads
        v = below.lex[level.history[part]]  # in order
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])
        every, n = v[first], np.diff(np.append(first, len(v)))
        if len(extra[b]):
            more = np.union1d(every, below.lex[extra[b]])
            n = np.bincount(np.searchsorted(more, every), weights=n, minlength=len(more)).astype(np.int64)
            every = more
        ids = self.wide(k - 1)[every]
        return part, ids, n, hot[ids]

    def wide(self, k: int) -> np.ndarray:
        """The id of the n-gram at each place in the order by tokens."""
        if self.levels[k].wide is None:
            self.levels[k].wide = np.argsort(self.levels[k].lex).astype(np.int32)
        return self.levels[k].wide

    def columns(self, k: int, ids: np.ndarray) -> list[np.ndarray]:
        """Numbers of the tokens of n-grams of order k."""
        level = self.levels[k]
        return [*(self.columns(k - 1, level.history[ids]) if k > 1 else ()), self.number[level.token[ids]]]

    def question(self, k: int, b: int) -> bytes:
        level = self.levels[k]
        if k == 1:
            part = slice(level.cuts[b], level.cuts[b + 1])
            return pack(level.names[part], planes(level.own[part]))
        part, ids, n, hot = self.heads(k, b)
        columns, own = self.columns(k - 1, ids), level.own[part]
        # the next token is a column too, of rows of their own
        *_, token = steps([np.repeat(np.arange(len(ids)), n), self.number[level.token[part]]])
        # of n-grams that the block has in training, the count one order down; once for each of the shorter n-grams
        seen = np.flatnonzero(own)
        _, first = np.unique(folded([c[np.repeat(np.arange(len(ids)), n)[seen]] for c in columns[1:]] + [self.number[level.token[part]][seen]]), return_index=True)
        tall = self.levels[k - 1].count[level.low[part][seen[first]]]
        return pack(*map(planes, steps(columns)), planes(n), np.packbits(hot), planes(token), planes(own), planes(tall))

    def take(self, k: int, right: pa.Table) -> None:
        """The answers on order k: counts, tokens' numbers, sums of histories, counts of counts."""
        level = self.levels[k]
        level.count, stats, ids, sums = np.zeros(len(level.token), np.int64), 0, [], []
        if k == 1:
            self.number = np.zeros(len(level.token), np.int64)
        else:
            level.flat = np.zeros(len(self.levels[k - 1].token), bool)
        mine = np.flatnonzero(right["level"].to_numpy() == k)
        for b, data in zip(right["bucket"].to_numpy()[mine].tolist(), (right["data"][int(i)].as_py() for i in mine)):
            part = slice(level.cuts[b], level.cuts[b + 1])
            if k == 1:
                count, number, told = unpack(data, np.uint8, np.uint8, np.int64)
                level.count[part], self.number[part] = unplanes(count), unplanes(number)
            else:
                count, flat, needed, s, told = unpack(data, np.uint8, np.uint8, np.uint8, np.uint8, np.int64)
                level.count[part] = unplanes(count)
                _, heads, _, hot = self.heads(k, b)
                level.flat[heads[np.unpackbits(flat, count=len(heads)).astype(bool) & ~hot]] = True
                some = heads[np.unpackbits(needed, count=len(heads)).astype(bool)]
                ids.append(some)
                sums.append(unplanes(s).reshape(_SUMS, len(some)))
            stats = stats + told
        self.stats.append(stats)
        if k == 1:
            level.wide = np.argsort(self.number).astype(np.int32)
            level.lex = np.empty_like(level.wide)
            level.lex[level.wide] = np.arange(len(level.wide), dtype=np.int32)
        else:
            who, inverse = np.unique(np.concatenate([*ids, np.zeros(0, np.int32)]), return_inverse=True)
            rows = np.concatenate([np.zeros((_SUMS, 0), np.int64), *sums], axis=1)
            total = np.stack([np.bincount(inverse, weights=x.astype(float), minlength=len(who)) for x in rows])
            level.sums = who, total
            level.flat[who] = (total[:TOP] == 0).all(axis=0)

    def upto(self, k: int, right: pa.Table | None) -> "_Block":
        """With all n-grams up to order k, and the answers on those below it; on k, too, if right has them."""
        for j in range(1, k + 1):
            if j > 1:
                self.grow(j)
            if right is not None and (right["level"].to_numpy() == j).any():
                self.take(j, right)
        return self


def _rows(schema: dict, **columns):
    return pa.table({k: pa.array(columns[k], t) for k, t in schema.items()})


_ASK = {"bucket": pa.int32(), "block": pa.int32(), "data": pa.binary()}
_TOLD = {"block": pa.int32(), "level": pa.int32(), "bucket": pa.int32(), "data": pa.binary()}
ASK, TOLD = "bucket int, block int, data binary", "block int, level int, bucket int, data binary"


def ask(k: int, buckets: int, share: int):
    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not left.num_rows:
            return _rows(_ASK, bucket=[], block=[], data=[])
        b = _Block(left, buckets, share).upto(k, right)
        return _rows(_ASK, bucket=range(buckets), block=[left["block"][0].as_py()] * buckets, data=[b.question(k, i) for i in range(buckets)])

    return (lambda t: run(t)) if k == 1 else run


def _sums(of, n, r, c) -> np.ndarray:
    """Per history: n-grams of count 1..TOP, sum of larger counts; of the n-grams one order down that these end with, the same."""
    out = np.zeros((_SUMS, n), np.int64)
    for row, x in ((0, r), (TOP + 1, c)):
        out[row : row + TOP] = np.bincount(of * (TOP + 1) + np.minimum(x, TOP + 1) - 1, minlength=n * (TOP + 1)).reshape(n, TOP + 1).T[:TOP]
        big = x > TOP
        out[row + TOP] = np.bincount(of[big], weights=x[big].astype(float), minlength=n).astype(np.int64)
    return out


def _counts_of_counts(r: np.ndarray) -> np.ndarray:
    return np.bincount(r[(r > 0) & (r <= TOP + 1)], minlength=TOP + 2)[1:]


class _Bucket:
    """What the blocks ask of a bucket, put together: totals of distinct n-grams, sums of histories; with tokens, what they are made of."""

    def __init__(self, k: int, t: pa.Table, buckets: int, named: bool = False):
        self.k, self.blocks, self.bucket = k, t["block"].to_pylist(), t["bucket"][0].as_py()
        data = t["data"].to_pylist()
        if k == 1:
            got = [unpack(x, np.uint64, np.uint8) for x in data]
            own = [unplanes(x[1]) for x in got]
            self.keys, self.inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        else:
            self.columns, self.hot, self.lacks, self.token = [], [], [], []
            heads, keys, own, tall, owner = [], [], [], [], []
            for x in data:
                *cols, n, hot, w, o, c = unpack(x, *[np.uint8] * (k + 4))
                cols, n, o = unsteps([unplanes(y) for y in cols]), unplanes(n), unplanes(o)
                h = folded(cols)
                of = np.repeat(np.arange(len(n), dtype=np.int32), n)
                turn = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
                w = unplanes(w)
                total = np.cumsum(w)
                w = total - np.repeat((total - w)[turn], np.diff(np.append(turn, len(w))))
                keys.append(core.mix(h[of] * core._R ^ w.astype(np.uint64)))
                if named:
                    self.columns.append(cols)
                    self.token.append(w)
                heads.append(h)
                self.hot.append(np.unpackbits(hot, count=len(n)).astype(bool))
                self.lacks.append(np.bincount(of[o == 0], minlength=len(n)) > 0)
                own.append(o.astype(np.int32))
                seen = np.flatnonzero(o)
                _, place = np.unique(folded([y[of[seen]] for y in cols[1:]] + [w[seen]]), return_inverse=True)
                low = np.zeros(len(o), np.int64)
                low[seen] = unplanes(c)[place]
                tall.append(low)
                owner.append(of)
            self.history, inverse = np.unique(np.concatenate(heads), return_inverse=True)
            edges = np.append(0, np.cumsum([len(h) for h in heads]))
            del heads
            inverse = inverse.astype(np.int32)
            self.of = [inverse[a:z] for a, z in zip(edges[:-1], edges[1:])]
            keys = np.concatenate(keys)
            self.keys, self.inverse = np.unique(keys, return_inverse=True)
            del keys
            self.inverse = self.inverse.astype(np.int32)
            owner = np.concatenate([self.of[i][of] for i, of in enumerate(owner)])
            self.token = np.concatenate(self.token) if named else None
        self.edges = np.append(0, np.cumsum([len(o) for o in own]))
        own = np.concatenate(own)
        self.total = np.bincount(self.inverse, weights=own.astype(float), minlength=len(self.keys)).astype(np.int64)
        self.seen = np.flatnonzero(self.total)
        if k == 1:
            # tokens are numbered by falling count, so that most n-grams are of small numbers
            rank = np.empty(len(self.keys), np.int64)
            rank[np.argsort(-self.total, kind="stable")] = np.arange(len(rank))
            self.number = rank * buckets + self.bucket
            real = self.total[self.keys != BEGIN]
            self.stats = np.concatenate([[real.sum(), np.count_nonzero(real)], _counts_of_counts(real)])
        else:
            entry = np.zeros(len(self.keys), np.int64)
            told = np.flatnonzero(own)  # these know the count one order down
            entry[self.inverse[told]] = told
            self.entry = entry[self.seen]
            self.owner = owner[self.entry]
            self.sums = _sums(self.owner.astype(np.int64), len(self.history), self.total[self.seen], np.concatenate(tall)[self.entry])
            self.flat = (self.sums[:TOP] == 0).all(axis=0)
            self.stats = _counts_of_counts(self.total)

    def answer(self, i: int) -> bytes:
        a, z = self.edges[i], self.edges[i + 1]
        count = planes(self.total[self.inverse[a:z]])
        if self.k == 1:
            return pack(count, planes(self.number[self.inverse[a:z]]), self.stats.astype(np.int64))
        of, need = self.of[i], self.lacks[i] | self.hot[i]
        return pack(count, np.packbits(self.flat[of]), np.packbits(need), planes(self.sums[:, of[need]].ravel()), self.stats.astype(np.int64))


def count(k: int, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        b, n = _Bucket(k, t, buckets), t.num_rows
        return _rows(_TOLD, block=b.blocks, level=[k] * n, bucket=[b.bucket] * n, data=[b.answer(i) for i in range(n)])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..TOP (0: unused) from counts of counts n[0] (of 1) to n[TOP]; where they aren't between 0 and 1, (r - 0.5) / r."""
    r = np.arange(1, TOP + 1)
    d = np.full(TOP, -1.0)
    if (n > 0).all():
        last = (TOP + 1) * n[TOP] / n[0]
        if last < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - last) / (1 - last)
    return np.append(1.0, np.where((d > 0) & (d < 1), d, (r - 0.5) / r))


class Model:
    """What all corpus counts give together: N, V, discounts of each order and the mass of unseen tokens."""

    def __init__(self, stats: list[np.ndarray]):
        first, *others = stats
        self.n, self.v = int(first[0]), int(first[1])
        self.discounts = [discounts(first[2:]), *map(discounts, others)]
        left = float((first[2 : 2 + TOP] * np.arange(1, TOP + 1) * (1 - self.discounts[0][1:])).sum())
        # nothing to discount: one count more, for the unseen class
        self.total, self.unseen = (self.n, left / self.n) if left > 0 else (self.n + 1, 1 / (self.n + 1))

    def kept(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of order k."""
        return np.where(c > TOP, 1.0, self.discounts[k - 1][np.minimum(c, TOP)]) * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.kept(1, c) / self.total, self.unseen)

    def mass(self, k: int, sums: np.ndarray) -> np.ndarray:
        """Sum of discounted counts, from numbers of counts 1..TOP and the sum of larger ones."""
        return self.kept(k, np.arange(1, TOP + 1)) @ sums[:TOP] + sums[TOP]


_SCORE = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def evaluate(order: int, buckets: int, share: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(_SCORE, **{k: [] for k in _SCORE})
        b = _Block(left, buckets, share).upto(order, right)
        m, one = Model(b.stats), b.levels[1]
        c = one.count[one.of]
        p, divisor = m.unigram(c), None
        for k in range(2, order + 1):
            level, below = b.levels[k], b.levels[k - 1]
            who, sums = level.sums
            total = np.arange(1, TOP + 1) @ sums[:TOP] + sums[TOP]
            flat = level.flat[who]
            left_over = np.where(flat, 1.0, total - m.mass(k, sums)) / np.where(flat, total + 1, total)
            lower = m.mass(k - 1, sums[TOP + 1 :]) / (m.total if k == 2 else np.maximum(divisor[below.low[who]], 1))
            back = np.ones(len(below.token))
            back[who] = left_over / np.maximum(1 - lower, 1e-300)
            divisor = below.count + level.flat
            at, h = b.before(k)
            r = level.count[level.of[at]]
            p[at] = np.where(r > 0, m.kept(k, r) / np.maximum(divisor[h], 1), back[h] * p[at])
        heads = b.begins[:-1]
        sums = lambda x: np.add.reduceat(x, heads) if len(heads) else x[:0]  # noqa: E731 - every text has its end token
        return _rows(
            _SCORE, doc_id=b.rows["doc_id"].combine_chunks(), held_out=[not x for x in b.rows["training"].to_pylist()], n_tokens=np.diff(b.begins), n_known=sums((c > 0).astype(np.int64)), train_tokens=[m.n] * len(heads),
            base_score=sums(np.log10((c + 1) / (m.n + m.v + 1))), score=sums(np.log10(p)),
        )

    return run


def _plan(docs: DataFrame, training, order: int, n: int | None, id_col: str, text: str, share: int | None):
    """(buckets, share, grouped blocks, grouped questions of each order, answers of each order, and the ways of both)."""
    n = n or core.block_count(docs, text)
    buckets = n
    share = share or max(SHARE, n * core.BLOCK_BYTES // SPREAD)
    core.bound_batches(docs.sparkSession)
    b = core.blocks(docs, n, id_col, text).withColumn("training", training(F.col("doc_id")))
    b = b.mapInArrow(squeezed, "block int, doc_id long, text binary, training boolean")
    there, back = core.Relay("block", "bucket", n, buckets, ASK), core.Relay("bucket", "block", buckets, n, TOLD)
    groups, asked, told = b.groupBy("block"), [], []
    for k in range(1, order + 1):
        if k == 1:
            q = there.send(groups, ask(1, buckets, share))
        else:
            q = there.send(groups.cogroup(functools.reduce(DataFrame.unionByName, told).groupBy("block")), _opening(back, ask(k, buckets, share), True), other=True)
        asked.append(q.groupBy("bucket"))
        # dealt by block here, so that answers are made and shuffled once for all the steps that read them
        told.append(back.send(asked[-1], _opening(there, count(k, buckets))).repartition("block"))
    return buckets, share, groups, asked, told, there, back


def _opening(way: core.Relay, f, second: bool = False):
    """f, whose only or second table comes by a way."""
    if not way.on:
        return f
    return (lambda left, right: f(left, way.opened(right))) if second else (lambda t: f(way.opened(t)))


TABLE = "order int, bucket int, hash long, ids array<long>, count long"
SUMS = "order int, bucket int, ids array<long>, sums array<long>"


def _grams(k: int, buckets: int):
    """Rows of TABLE: n-grams seen in training, tokens by number; of order 1 also their hash."""

    def run(t: pa.Table) -> pa.Table:
        b = _Bucket(k, t, buckets, named=True)
        n = len(b.seen)
        if k == 1:
            columns, hashes = [b.number[b.seen]], b.keys[b.seen].view(np.int64)
        else:
            columns, hashes = [*_named(b, b.owner), b.token[b.entry]], [None] * n
        return _rows({"order": pa.int32(), "bucket": pa.int32(), "hash": pa.int64(), "ids": pa.list_(pa.int64()), "count": pa.int64()}, order=[k] * n, bucket=[b.bucket] * n, hash=hashes, ids=np.stack(columns, axis=1).tolist(), count=b.total[b.seen])

    return run


def _named(b: _Bucket, owner: np.ndarray) -> list[np.ndarray]:
    """Tokens of histories, by their place in the bucket."""
    place = np.concatenate(b.of)
    first = np.zeros(len(b.history), np.int64)
    first[place] = np.arange(len(place))
    return [np.concatenate([c[j] for c in b.columns])[first[owner]] for j in range(b.k - 1)]


def _histories(k: int, buckets: int):
    """Rows of SUMS: what a bucket has of each history that was seen."""

    def run(t: pa.Table) -> pa.Table:
        b = _Bucket(k, t, buckets, named=True)
        who = np.unique(b.owner)
        return _rows({"order": pa.int32(), "bucket": pa.int32(), "ids": pa.list_(pa.int64()), "sums": pa.list_(pa.int64())}, order=[k] * len(who), bucket=[b.bucket] * len(who), ids=np.stack(_named(b, who), axis=1).tolist(), sums=b.sums[:, who].T.tolist())

    return run


def model_tables(docs: DataFrame, path: str, training=None, order: int = ORDER, blocks: int | None = None, id_col: str = "doc_id", text: str = "text", share: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the model under path, as Parquet by order and bucket, and read it: rows of TABLE, and of SUMS (histories, to be added up)."""
    buckets, *_, asked, _, there, _ = _plan(docs, training or (lambda c: F.lit(True)), order, blocks, id_col, text, share)
    spark, union = docs.sparkSession, lambda parts: functools.reduce(DataFrame.unionByName, parts)
    union([q.applyInArrow(_opening(there, _grams(k, buckets)), TABLE) for k, q in enumerate(asked, 1)]).write.partitionBy("order", "bucket").parquet(f"{path}/grams")
    sums = [q.applyInArrow(_opening(there, _histories(k, buckets)), SUMS) for k, q in enumerate(asked, 1) if k > 1]
    if sums:
        union(sums).write.partitionBy("order", "bucket").parquet(f"{path}/histories")
    return spark.read.schema(TABLE).parquet(f"{path}/grams"), spark.read.schema(SUMS).parquet(f"{path}/histories") if sums else spark.createDataFrame([], SUMS)


def score(docs: DataFrame, training=None, order: int = ORDER, blocks: int | None = None, id_col: str = "doc_id", text: str = "text", share: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score: log10 probabilities of whole texts.

    training(id column) marks the rows to learn from; all of them by default.
    """
    buckets, share, groups, _, told, _, way = _plan(docs, training or (lambda c: F.lit(True)), order, blocks, id_col, text, share)
    back = functools.reduce(DataFrame.unionByName, told)
    return groups.cogroup(back.groupBy("block")).applyInArrow(_opening(way, evaluate(order, buckets, share), True), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
