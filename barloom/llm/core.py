"""What the corpus operators share: flat views of Arrow text, word and n-gram hashes, document blocks.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR. All of these are ASCII, so a
UTF-8 text can be cut at byte level. Hashes are 64 bits wide and mixed, the same in every process.

A *block* is a bounded group of whole documents, chosen by a hash of the row, so no source or key
decides where a document goes. Operators that compare a document with the whole corpus pre-aggregate in
its block, send each distinct key once per block to a bucket, and get one short answer per block back.
A key held by a third of all rows so costs one entry per block, not one per row.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def give_back() -> None:
    """Let this worker's large buffers go back to the system when freed, at some cost in time; workers outlive their tasks."""
    import ctypes
    import sys

    pa.set_memory_pool(pa.system_memory_pool())
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


#: Bytes of text that one block holds on average.
BLOCK_BYTES = 12 << 20

U = np.uint64
_R = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 512  # words of more bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, in place where it can be."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


#: A hash of each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _R)


def flat(text: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    a = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the flat bytes, and the index of each document's first word."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~space[buf]
    edge = np.empty(n, bool)
    edge[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=edge[1:])
    first = off[:-1][off[:-1] < off[1:]]
    edge[first] = inside[first]
    s = np.flatnonzero(edge)
    edge[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=edge[:-1])
    edge[off[1:][off[:-1] < off[1:]] - 1] = inside[off[1:][off[:-1] < off[1:]] - 1]
    e = np.flatnonzero(edge) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    n = e - s
    h = n.astype(np.uint64) * _R
    if not len(s):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(buf) + 1,), "<u8", buffer=padded, strides=(1,))
    long = np.flatnonzero(n > _LONG)
    live, at = None, 0
    while True:
        a, m = (s, n) if live is None else (s[live], n[live])
        if not len(a):
            break
        v = lanes[a + at] & _MASK[np.minimum(m - at, 8)]
        if live is None:
            h = mix(h ^ v)
        else:
            h[live] = mix((h[live] * _R) ^ v)
        at += 8
        live = np.flatnonzero((n > at) & (n <= _LONG)) if live is None else live[n[live] > at]
    if len(long):
        from hashlib import blake2b

        for i in long:
            h[i] = np.frombuffer(blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k entries of h: a polynomial, put together from runs of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, width, part, size, base = None, 0, h, 1, _R
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if out is None:
                    out = part[:n].copy()
                else:
                    out *= base
                    out += part[width : width + n]
                width += size
            if width == k:
                return mix(out)
            part = part[: len(part) - size] * base + part[size:]
            base = base * base
            size *= 2


def owners(counts_at: np.ndarray) -> np.ndarray:
    """The document of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(counts_at) - 1), np.diff(counts_at))


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    n, width, m = len(h) - w + 1, 1, h
    while 2 * width <= w:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return np.minimum(m[:n], m[w - width : w - width + n]) if n > 0 else h[:0]


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a local one only in local mode, where all tasks see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/barloom-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither recompute it nor need the executors that made it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, least: int | None = None) -> int:
    """So many blocks that one holds about block_bytes of text, and `least` (one for each core) at least; one pass over the text column."""
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism if least is None else least, math.ceil(n / block_bytes))


def blocks(docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, id, text), dealt once by a hash of the row; its exchange is reused by all who group it by block."""
    b = F.pmod(F.xxhash64(id_col, text), F.lit(n)).cast("int")
    return docs.select(b.alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))


def ordered(t: pa.Table, content: str = "text") -> pa.Table:
    """The rows of a block by doc_id (null first), then content: one order for every reading of it.

    A shuffle's rows come in the order in which they are fetched, which differs between two reads and between attempts.
    What names a row by its place in a block takes this order first. Rows with equal id and content are interchangeable.
    """
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), (content, "ascending")], null_placement="at_start"))


def bound_batches(spark: SparkSession, records: int = 1000, n_bytes: int = 8 << 20) -> None:
    """Keep Arrow batches of texts small: at most so many records, and bytes where this Spark can bound them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", n_bytes)):
        now = int("".join(filter(str.isdigit, spark.conf.get(key))) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def hex_sha256(parts) -> str:
    from hashlib import sha256

    return sha256(parts).hexdigest()


def ids(col) -> np.ndarray:
    """An id column for ordering; null comes first."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return a.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


#: With more blocks than this, messages between blocks and buckets go by way of groups of both.
RELAY = 256


def _stored(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _parcels(t: pa.Table, key: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The rows of t by key, each key's as one value."""
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    ends = np.append(first[1:], len(order))
    return values.tolist(), [_stored(t.take(pa.array(order[a:z]))) for a, z in zip(first, ends)]


class Relay:
    """The way of rows from n_from senders to n_to receivers, columns `sender` and `receiver` of a schema (DDL).

    Directly, that is a row for each pair that has something to say: the square of their number, when both grow with the corpus.
    By way of groups, a sender writes a row for each group of about sqrt(n_to) receivers; rows of a group of senders and a group of
    receivers meet in a hop, which writes a row for each receiver. That makes n_from * sqrt(n_to) + sqrt(n_from) * n_to rows. The same
    bytes are shuffled once more, so a few senders do without.
    """

    def __init__(self, sender: str, receiver: str, n_from: int, n_to: int, schema: str, on: bool | None = None):
        self.sender, self.receiver, self.schema = sender, receiver, schema
        self.on = n_from > RELAY if on is None else on
        self.senders, self.receivers = math.isqrt(max(0, n_from - 1)) + 1, math.isqrt(max(0, n_to - 1)) + 1

    def send(self, grouped, f, other=None) -> DataFrame:
        """Rows for `groupBy` of receivers: f's of each group (a table, or two of a cogroup) as they are, or as parcels."""
        if not self.on:
            return grouped.applyInArrow(f, self.schema)
        names = (self.sender, self.receiver)

        def parcelled(t: pa.Table) -> pa.Table:
            a, b = (t[c].to_numpy().astype(np.int64) for c in names)
            hop, data = _parcels(t, (a // self.senders) << 32 | b // self.receivers)
            return pa.table({"hop": pa.array(hop, pa.int64()), "data": pa.array(data, pa.binary())})

        def met(t: pa.Table) -> pa.Table:
            rows = self.opened(t)
            to, data = _parcels(rows, rows[self.receiver].to_numpy().astype(np.int64))
            return pa.table({self.receiver: pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})

        made = grouped.applyInArrow((lambda x, y: parcelled(f(x, y))) if other else (lambda x: parcelled(f(x))), "hop long, data binary")
        return made.groupBy("hop").applyInArrow(met, f"{self.receiver} int, data binary")

    def opened(self, t: pa.Table) -> pa.Table:
        """The rows of the senders, from those that `send` made."""
        if not self.on:
            return t
        parts = [pa.ipc.open_stream(x).read_all() for x in t["data"].to_pylist()]
        if parts:
            return pa.concat_tables(parts)
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        return to_arrow_schema(StructType.fromDDL(self.schema)).empty_table()
