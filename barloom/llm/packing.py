"""Best-fit-decreasing packing of token ids into rows of one length, and their binary form.

Texts become ids where they are read, with the vocabulary's end id after each, and only the ids are shuffled: documents
are dealt into blocks of bounded size by a hash, and a block is packed on its own. A document's ids are cut into pieces of
the row length (the last one shorter), so nothing is lost. Pieces go by falling length into the row with the least room
that still fits, found in a segment tree over room: each leaf counts the open rows with that room, each node those below it.

A packed row has its ids as a little-endian unsigned 16 or 32-bit matrix row filled up with the pad id, cumulative
segment lengths (0 first, as attention kernels take them), the positions at which position ids start again, and for
each segment its document and the place in the document's ids. So documents can be put together again.
`store` writes each block's matrix as one raw file and gives the other columns with file and offset, and `load` reads the rows
back. A file carries its attempt in its name, and only files of the attempts that were committed are pointed to.

Nulls: a null text is empty, so it is its end id alone; null ids are kept. Repeated rows are packed each. Ties go by
id, then by content; among rows with equal room, to the one opened first. How many blocks there are follows from the
text's size alone, so the rows don't depend on the cluster. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, media

LENGTH = 4096
#: Bytes of text in a block: small ones deal the work evenly, at a cost of less than a row each.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Vocabulary:
    """ids: text column -> (flat ids, offsets of the texts), without end ids; end and pad: ids of no text; dtype holds all."""

    ids: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    end: int
    pad: int

    @property
    def dtype(self):
        return np.dtype("<u2" if max(self.end, self.pad) < 1 << 16 else "<u4")


#: Bytes as ids 0-255.
BYTES = Vocabulary(core.flat, 256, 257)


@functools.lru_cache(maxsize=4)
def _encoding(data: bytes, pattern: str):
    import tiktoken

    from . import bpe

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.read_ranks(data), special_tokens={})


def ranked(data: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file: ids as byte-level BPE gives them. End and pad are the next ids after the last rank."""
    from . import bpe

    def ids(column: pa.Array):
        e = _encoding(data, pattern)
        parts = [e.encode_to_numpy(x, disallowed_special=()) for x in column.fill_null("").to_pylist()]
        off = np.append(0, np.cumsum([len(x) for x in parts]))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), off

    top = max(bpe.read_ranks(data).values())
    return Vocabulary(ids, top + 1, top + 2)


@functools.lru_cache(maxsize=4)
def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None) -> Vocabulary:
    """An installed public rank file; path overrides where it lies."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), "rb") as f:
        return ranked(f.read(), public_tokenizers.PATTERN)


class Rooms:
    """Open rows by room, 0 to size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, deque[int]] = {}

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, deque()).append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room that is not under need; the row is no longer open."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i ^ 1]):  # up, until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.rows[room].popleft()


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The row of each piece; rows are numbered in the order in which they are opened."""
    out = np.empty(len(sizes), np.int64)
    rooms, n = Rooms(length), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = rooms.take(size)
        if found is None:
            room, row = length, n
            n += 1
        else:
            room, row = found
        out[i] = row
        if room > size:
            rooms.put(room - size, row)
    return out


SCHEMA = "block int, row int, ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"
INDEX = SCHEMA.replace("ids binary, ", "") + ", file string, offset long, length long"


def encoded(docs: DataFrame, v: Vocabulary, n: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, ids binary): the ids of each text and its end id. One scan."""
    core.bound_batches(docs.sparkSession)
    size = v.dtype.itemsize

    def run(batches):
        for b in batches:
            flat, off = v.ids(b.column(0))
            ends = off[1:] + np.arange(len(b))
            out = np.empty(len(flat) + len(b), v.dtype)
            mask = np.ones(len(out), bool)
            mask[ends] = False
            out[mask], out[ends] = flat, v.end
            offsets = np.append(0, ends + 1) * size
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())], names=["block", "doc_id", "ids"])

    block = F.pmod(F.xxhash64(id_col, text), F.lit(n)).cast("int").alias("block")
    return docs.select(F.col(text), block, F.col(id_col).cast("long").alias("doc_id")).mapInArrow(run, "block int, doc_id long, ids binary")


def _packed(t: pa.Table, length: int, v: Vocabulary) -> pa.Table:
    """Rows of SCHEMA from the ids of a block's documents."""
    t = core.ordered(t, "ids")
    flat, off = core.flat(t["ids"])
    flat, off = flat.view(v.dtype), off // v.dtype.itemsize
    count = -(-np.diff(off) // length)
    doc = np.repeat(np.arange(len(count)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
    size = np.minimum(np.diff(off)[doc] - start, length)
    row = best_fit(size, length)
    order = np.argsort(row, kind="stable")
    row, doc, start, size = row[order], doc[order], start[order], size[order]
    n_rows = int(row[-1]) + 1 if len(row) else 0
    first = np.searchsorted(row, np.arange(n_rows + 1))
    done = np.append(0, np.cumsum(size))
    inner = done[:-1] - done[first[:-1]][row] if n_rows else done[:-1]
    out = np.full(n_rows * length, v.pad, v.dtype)
    for a, z, at in zip((off[doc] + start).tolist(), (off[doc] + start + size).tolist(), (row * length + inner).tolist()):
        out[at : at + z - a] = flat[a:z]
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    used = done[first[1:]] - done[first[:-1]]
    ends = np.insert(inner, first[1:], used) if n_rows else inner  # each row's starts, then its length
    width = length * v.dtype.itemsize
    return pa.table({
        "block": pa.array(np.full(n_rows, t["block"][0].as_py()), pa.int32()), "row": pa.array(np.arange(n_rows), pa.int32()),
        "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_rows, [None, pa.py_buffer(np.arange(n_rows + 1) * width), pa.py_buffer(out)]).cast(pa.binary()),
        "n_tokens": pa.array(used, pa.int32()), "cu_seqlens": lists(first + np.arange(n_rows + 1), pa.array(ends, pa.int32())), "resets": lists(first, pa.array(inner, pa.int32())),
        "doc_ids": lists(first, t["doc_id"].combine_chunks().take(pa.array(doc))), "starts": lists(first, pa.array(start, pa.int64())),
    })


def _blocks(docs: DataFrame, v: Vocabulary, blocks: int | None, id_col: str, text: str):
    n = blocks or core.block_count(docs, text, BLOCK_BYTES, least=1)
    return encoded(docs, v, n, id_col, text).groupBy("block")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: Vocabulary = BYTES, blocks: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of SCHEMA, with the matrix rows in column ids."""
    return _blocks(docs, vocabulary, blocks, id_col, text).applyInArrow(lambda t: _packed(t, length, vocabulary), SCHEMA)


def store(docs: DataFrame, base: str, length: int = LENGTH, vocabulary: Vocabulary = BYTES, blocks: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each block's matrix as a raw file under base; rows of INDEX. Write the index down before reading it twice."""

    def run(t: pa.Table) -> pa.Table:
        from pyarrow import fs

        t = _packed(t, length, vocabulary)
        files, path = fs.FileSystem.from_uri(base)
        files.create_dir(path, recursive=True)
        c = TaskContext.get()
        name = f"block-{t['block'][0].as_py():06d}-{c.attemptNumber() if c else 0}-{uuid.uuid4().hex[:8]}.bin"
        with files.open_output_stream(f"{path}/{name}") as f:
            for chunk in t["ids"].chunks:
                f.write(core.flat(chunk)[0])
        width = length * vocabulary.dtype.itemsize
        return t.drop(["ids"]).append_column("file", pa.array([name] * t.num_rows)).append_column("offset", pa.array(np.arange(t.num_rows) * width)).append_column("length", pa.array([width] * t.num_rows, pa.int64()))

    return _blocks(docs, vocabulary, blocks, id_col, text).applyInArrow(run, INDEX)


def load(index: DataFrame, base: str) -> DataFrame:
    """index with column ids, the matrix rows read back from the files, each file's rows by one task."""
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches):
        for b in batches:
            got = [b""] * len(b)
            for i, data in media.ranges(b.select(["file", "offset", "length"]), base):
                got[i] = data
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=schema.names)

    return media.by_file(index, "file").mapInArrow(run, schema)
