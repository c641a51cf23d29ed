"""Product codes of vectors; the nearest codebook entry is found by VA-file filtering.

Components become integers (floor of scale * x) and vectors are cut into equal consecutive parts, each with a codebook of
its own. Codebooks begin as the parts of the vectors with the smallest ids; a round assigns every part to its nearest entry
and moves each entry to the floor of the mean of its parts. All arithmetic is on integers, so results don't depend on the
order or the partitions in which rows come.

Nearest entries: the entries' coordinates are quantised to a few bits, each cell keeping the least and greatest coordinate
in it. For a query, a table per coordinate and cell holds the least and greatest squared distance that the cell allows; their
sums bound each entry's distance from below and above. Entries whose lower bound is over the least upper bound can't be
nearest; exact distances are taken of the others alone.

A round is one scan: tasks give count and sums per part and entry, at most parts * entries rows each, and these are summed
by key. Codebooks have entries * dimension integers, whatever the number of rows, so they go through the driver.

Rows whose vector is null or holds null or non-finite components are left out. Repeated rows and ids each count; among
rows with equal ids, vectors decide; null ids come last. With fewer rows than entries, there are fewer entries. A vector
whose length isn't a multiple of the parts, or shorter than the longest, counts as if zeros followed. Components beyond
+-2**LIMIT_BITS (after scaling) count as that, so that sums fit 64 bits. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELL_BITS = 4
LIMIT_BITS = 26
#: More labels than this are joined by shuffle, not by broadcast.
FEW_LABELS = 10_000
SALT = 32


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    return vectors.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """(rows, width) of floor(scale * x), with zeros after a vector's end."""
    a = column if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    flat = a.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.diff(a.offsets.to_numpy())
    top = float(1 << LIMIT_BITS)
    x = np.clip(np.floor(flat * scale), -top, top).astype(np.int64)
    if len(size) and (size == width).all():
        return x.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = x
    return out


class Cells:
    """The VA-file of one part's entries."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        n, width = entries.shape
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.cell = ((entries - low) << bits) // (high - low + 1)
        # what a cell holds; an empty one is never looked up
        self.low = np.zeros((width, 1 << bits), np.int64)
        self.high = np.zeros((width, 1 << bits), np.int64)
        for d in range(width):
            for c in np.unique(self.cell[:, d]):
                inside = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """(queries, entries): whether an entry's bounds let it be nearest."""
        lower = np.zeros((len(q), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(q.shape[1]):
            x = q[:, d, None]
            under, over = self.low[d] - x, x - self.high[d]
            table = np.maximum(np.maximum(under, over), 0) ** 2
            lower += table[:, self.cell[:, d]]
            table = np.maximum(np.abs(under), np.abs(over)) ** 2
            upper += table[:, self.cell[:, d]]
        return lower <= upper.min(axis=1, keepdims=True)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query (the lowest of ties), and the squared distance."""
        row, entry = np.nonzero(self.candidates(q))
        dist = ((q[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(row, np.arange(len(q)))
        least = np.minimum.reduceat(dist, first) if len(q) else dist
        at = np.flatnonzero(dist == least[row])
        at = at[np.unique(row[at], return_index=True)[1]]
        return entry[at], least


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes and squared distances; books: (parts, entries, width)."""
    parts, _, width = books.shape
    index = np.empty((len(x), parts), np.int64)
    dist = np.empty_like(index)
    for p in range(parts):
        index[:, p], dist[:, p] = Cells(books[p]).nearest(x[:, p * width : (p + 1) * width])
    return index, dist


def seeds(vectors: DataFrame, width: int, parts: int, entries: int, scale: int, id_col: str, vector: str) -> np.ndarray:
    """(parts, entries, part width) of the smallest ids."""
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries)
    x = integers(rows.toArrow()["v"], width, scale)
    return x.reshape(len(x), parts, width // parts).transpose(1, 0, 2)


def moved(vectors: DataFrame, books: np.ndarray, scale: int, vector: str) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches):
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x = integers(b.column(0), parts * width, scale)
            index, _ = assign(x, books)
            cell = index + np.arange(parts) * entries
            count += np.bincount(cell.ravel(), minlength=len(count))
            np.add.at(total, cell.ravel(), x.reshape(-1, width))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))], names=["cell", "n", "sums"])

    got = vectors.select(vector).mapInArrow(run, "cell long, n long, sums array<long>")
    got = got.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).toArrow()
    out = books.reshape(-1, width).copy()
    out[got["cell"].to_numpy()] = np.array(got["sums"].to_pylist(), np.int64).reshape(-1, width) // got["n"].to_numpy()[:, None]
    return out.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> np.ndarray | None:
    """(parts, entries, part width) of integers, fitted on all rows; None without rows."""
    rows = kept(vectors, vector)
    longest = rows.agg(F.max(F.size(vector))).first()[0]
    if longest is None:
        return None
    books = seeds(rows, max(1, -(-longest // parts)) * parts, parts, entries, scale, id_col, vector)
    for _ in range(rounds):
        books = moved(rows, books, scale, vector)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code: two hex digits a part, error: squared distances summed) of every kept row."""
    schema = T.StructType([*vectors.select(id_col, label).schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = kept(vectors, vector).select(id_col, label, vector)
    names = [id_col, label, "code", "error"]

    def run(batches):
        for b in batches:
            index, dist = assign(integers(b.column(2), books.shape[0] * books.shape[2], scale), books)
            digits = np.ascontiguousarray(index.astype(">u2" if books.shape[1] > 256 else np.uint8))
            code = [r.tobytes().hex() for r in digits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.string()), pa.array(dist.sum(axis=1))], names=names)

    if books is None:
        return rows.select(id_col, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return rows.mapInArrow(run, schema)


def with_label_error(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes with label_error: the error summed over rows of the same label, nulls together. Sums combine before their shuffle;
    few labels are broadcast, many are joined with the rows of a label salted."""
    sums = core.written(codes.groupBy(label).agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed(label, "_label")
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return codes.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = codes.withColumn("_s", F.pmod(F.xxhash64(*codes.columns), F.lit(SALT)).cast("int"))
    return salted.join(spread, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt"))).drop("_label", "_salt", "_s")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every kept row; the codes are written down once."""
    books = codebooks(vectors, parts, entries, rounds, scale, id_col, vector)
    codes = core.written(encode(vectors, books, scale, id_col, vector, label), "codes")
    return with_label_error(codes, label).withColumn("codebooks_sha256", F.lit(digest(books) if books is not None else ""))
