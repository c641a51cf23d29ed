"""Packing of documents into sequences of one length by exact complements: one plan for the whole corpus.

A document is its ids and an end id after them. Longer ones are cut into pieces of the full length, the first piece taking
what is over. What a plan needs to know of the corpus is how many pieces of each length there are, so a plan is made from
that histogram, which has `length` rows at most however many documents there are. It is a list of *patterns* (lengths that
share a sequence) with the number of sequences that take them. Each step uses up a length, or halves what is left of one at
least, so a plan has some thousand patterns.

1. The largest length left opens a sequence. Its gap is looked up in an index of sums: a single length, else a pair
   (counts of pairs by their sum, kept up as lengths run out), else a single whose rest is an indexed pair. Among equals the
   one with the largest piece goes first. As many sequences as the counts allow take the pattern at once.
2. Where nothing fills the gap exactly, the largest length that fits goes in (best fit), and the new gap is looked up
   as in 1. So residuals fill up too, and a sequence stays open only when nothing that is left fits.

Pieces get numbers within their length: tasks number what they write, and sums over the parts before are added. A
piece's number then says which sequence has it and where: runs of numbers lie in the order of the plan. No step needs the
pieces of a length, a source or a sequence in one task, and no block of documents has a rest of its own.

Nulls: a null text is empty, so it is its end id alone; null ids are kept. Repeated rows are packed each. An empty table gives no
rows. Very long texts are encoded whole, by the task that reads them. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core, packing

LENGTH = 2048
PIECES = "part int, nth long, doc_id long, piece int, start long, length int, ids binary"


@functools.lru_cache(maxsize=2)
def public_vocabulary(name: str = "byte_bpe_50k", path: str | None = None) -> packing.Vocabulary:
    """Ids of an installed vocabulary that comes both as a document of the tokenizers library and as ranks, with 0 as end id.

    Both give the same ids; ranks are encoded here, which takes a third of the time. Strings of special tokens are ordinary text.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        v = packing.ranked(f.read(), public_tokenizers.PATTERN)
    return packing.Vocabulary(v.ids, 0, v.pad)


def cut(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, size) of the pieces; a document's first piece takes what is over."""
    count = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = sizes - (count - 1) * length
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * length)
    return doc, piece, start, np.where(piece == 0, first[doc], length)


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: packing.Vocabulary = packing.BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of PIECES, ids as little-endian 32-bit integers; nth counts a part's pieces of a length from 0. Write it down before use."""
    core.bound_batches(docs.sparkSession)

    def run(batches):
        core.give_back()
        c = TaskContext.get()
        part = c.partitionId() if c else 0
        seen = np.zeros(length + 1, np.int64)
        for b in batches:
            flat, off = vocabulary.ids(b.column(1))
            ends = off[1:] + np.arange(len(b))
            ids = np.empty(len(flat) + len(b), "<u4")
            mask = np.ones(len(ids), bool)
            mask[ends] = False
            ids[mask], ids[ends] = flat, vocabulary.end
            at = np.append(0, ends + 1)
            doc, piece, start, size = cut(np.diff(at), length)
            order = np.argsort(size, kind="stable")
            same = size[order]
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.searchsorted(same, same) + seen[same]
            seen += np.bincount(size, minlength=length + 1)
            # pieces lie in the flat ids in the order of documents, without gaps
            bounds = np.append(at[doc] + start, at[-1]) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(size), part), pa.int32()), pa.array(nth), b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size, pa.int32()), data,
            ], names=["part", "nth", "doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, PIECES)


class Sums:
    """How many of each length are left, and an index of the sums that lengths make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        n = len(counts)
        self.there = self.left > 0
        #: pairs of two different lengths by sum, each once; doubles come from left
        self.pairs = np.zeros(2 * n, np.int64)
        lengths = np.flatnonzero(self.there)
        for a in lengths:
            self.pairs[a + lengths[lengths > a]] += 1

    def use(self, used: dict[int, int], times: int) -> None:
        for a, n in used.items():
            self.left[a] -= n * times
            if not self.left[a]:
                self.there[a] = False
                others = np.flatnonzero(self.there)
                self.pairs[a + others] -= 1

    def single(self, gap: int, used: Counter) -> list[int] | None:
        return [gap] if gap < len(self.left) and self.left[gap] > used[gap] else None

    def has_pair(self, gap: int) -> bool:
        return gap > 1 and (self.pairs[gap] > 0 or gap % 2 == 0 and gap // 2 < len(self.left) and self.left[gap // 2] > 1)

    def pair(self, gap: int, used: Counter) -> list[int] | None:
        """The pair with the largest piece."""
        if not self.has_pair(gap):
            return None
        a = np.arange((gap + 1) // 2, min(gap, len(self.left)))
        for x in a[self.there[a] & self.there[gap - a]][::-1].tolist():
            need = Counter((x, gap - x))
            if all(self.left[k] >= used[k] + n for k, n in need.items()):
                return [x, gap - x]
        return None

    def triple(self, gap: int, used: Counter) -> list[int] | None:
        """A single of at least a third of the gap whose rest is a pair, the largest first."""
        a = np.arange(-(-gap // 3), min(gap - 1, len(self.left)))
        a = a[self.there[a]]
        rest = gap - a
        doubled = (rest % 2 == 0) & (self.left[rest // 2] > 1)
        for x in a[(self.pairs[rest] > 0) | doubled][::-1].tolist():
            if self.left[x] > used[x]:
                found = self.pair(gap - x, used + Counter((x,)))
                if found:
                    return [x, *found]
        return None

    def largest(self, gap: int, used: Counter) -> int | None:
        """Best fit: the largest length that fits and is not used up."""
        fits = np.flatnonzero(self.there[: gap + 1])[::-1]
        return next((x for x in fits.tolist() if self.left[x] > used[x]), None)

    def pattern(self, top: int, most: int = 3) -> Counter:
        """What goes with a piece of length top; exact fillings are of so many pieces at most."""
        used, gap = Counter((top,)), len(self.left) - 1 - top
        while gap:
            exact = self.single(gap, used) or most > 1 and self.pair(gap, used) or most > 2 and self.triple(gap, used)
            if exact:
                return used + Counter(exact)
            x = self.largest(gap, used)
            if x is None:
                break
            used[x] += 1
            gap -= x
        return used


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}) for counts of the lengths 0 to the sequences' own; every piece is in one.

    Where no length is rare, triples leave nothing over; where large pieces are as common as small ones, they can spend small ones
    that fit better elsewhere. So plans with triples, with pairs and with singles are made, and the one with the fewest sequences stays.
    """

    def made(most: int) -> list[tuple[int, dict[int, int]]]:
        sums, out = Sums(counts), []
        for top in range(len(counts) - 1, 0, -1):
            while sums.left[top]:
                used = sums.pattern(top, most)
                times = int(min(sums.left[a] // n for a, n in used.items()))
                sums.use(used, times)
                out.append((times, dict(sorted(used.items(), reverse=True))))
        return out

    return min((made(most) for most in (3, 2, 1)), key=lambda p: sum(times for times, _ in p))


def runs(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, pieces in each sequence, first sequence, offset) in order of the numbers."""
    out: dict[int, list] = {}
    done: Counter = Counter()
    sequence = 0
    for times, used in patterns:
        offset = 0
        for a, n in used.items():
            out.setdefault(a, []).append((done[a], n, sequence, offset))
            done[a] += n * times
            offset += a * n
        sequence += times
    return {a: np.array(r, np.int64) for a, r in out.items()}


def places(length: np.ndarray, number: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces with these lengths and numbers."""
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    values, first = np.unique(length[order], return_index=True)
    for a, at in zip(values.tolist(), np.split(order, first[1:])):
        r = table[a]
        i = np.searchsorted(r[:, 0], number[at], "right") - 1
        past = number[at] - r[i, 0]
        sequence[at] = r[i, 2] + past // r[i, 1]
        offset[at] = r[i, 3] + past % r[i, 1] * a
    return sequence, offset


def packed(made: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of written PIECES with sequence_id and offset: sequences are numbered from 0, and gapless from offset 0."""
    counts = core.written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `length` rows at most
        totals[r["length"]] = r["n"]
    table = runs(plan(totals))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = made.columns

    def run(batches):
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            sequence, offset = places(cols["length"].to_numpy(), cols["nth"].to_numpy() + cols["before"].to_numpy(), table)
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields) + ", sequence_id long, offset long"
    return made.join(first, ["part", "length"]).mapInArrow(run, schema)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: packing.Vocabulary = packing.BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of PIECES with sequence_id and offset, and ids_crc32 of the ids. The ids are read once, then written once."""
    made = core.written(pieces(docs, length, vocabulary, id_col, text), "pieces")
    # ids aren't shuffled: only what names a piece is
    return packed(made.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), length)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: packing.Vocabulary = packing.BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids binary, segments array<struct<offset, doc_id, piece, length>>): the packed sequences themselves."""
    rows = packed(core.written(pieces(docs, length, vocabulary, id_col, text), "pieces"), length)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))  # a sequence is bounded by `length`
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("segments"),
    )
