"""Media columns: payloads in content-addressed tar shards, rows with digest, offset and length.

A text's bytes, padded with zero bytes to a positive multiple of 64, are the samples of a lossless 8-bit
greyscale PNG of width 64. Each task appends its images to tar shards in the shared folder; a member is
named by the SHA-256 of its content and is stored once per shard. The index table points into the shards,
so a reader fetches the 33 bytes of signature and header for the metadata columns, or a member's range for
all of it. Readers are dealt by shard. A shard carries its attempt in its name: a task that runs again writes shards of its own, and
only those of the attempt that was committed are pointed to.

A null text is an empty one, and an empty text has a payload of 64 zero bytes. Null ids are kept. Equal
texts have equal digests and values. Very long texts make a tall image (a limit of 2^31 - 1 rows). An empty
table writes no shard. Extra columns are not read.
"""

from __future__ import annotations

import struct
import tarfile
import uuid
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core

WIDTH = 64
SHARD_BYTES = 64 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "doc_id long, digest string, shard string, offset long, length long, n_bytes long"
#: Bytes between two members that are read over rather than sought past.
GAP = 1 << 16


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload, whole rows of 64 samples, as an unfiltered 8-bit greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return SIGNATURE + _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _part(b"IEND", b"")


def header(png: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type, from the first 33 bytes."""
    if png[:8] != SIGNATURE or png[12:16] != b"IHDR" or zlib.crc32(png[12:29]) != struct.unpack(">I", png[29:33])[0]:
        raise ValueError("no PNG header here")
    return struct.unpack(">IIBB", png[16:26])


def from_png(png: bytes) -> bytes:
    """The samples of an image that to_png made, with each part's checksum checked."""
    width, height, _, _ = header(png)
    at, data = 8, b""
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged part {kind!r}")
        if kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


class _Shards:
    """Tar shards of one task attempt."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(base)
        self.fs.create_dir(self.path, recursive=True)
        c = TaskContext.get()
        self.tag = f"{c.partitionId():06d}-{c.attemptNumber()}-{uuid.uuid4().hex[:8]}" if c else uuid.uuid4().hex
        self.n, self.out, self.at, self.known = 0, None, 0, {}

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name = f"shard-{self.tag}-{self.n:05d}.tar"
            self.n += 1
            self.out, self.at, self.known = self.fs.open_output_stream(f"{self.path}/{self.name}"), 0, {}
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.known[digest] = self.at + len(head)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.at += len(head) + len(data) + -len(data) % 512
        return self.name, self.known[digest]

    def close(self):
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store(docs: DataFrame, base: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the shards under base; the index of INDEX. One scan, no shuffle; write the index down before reading it twice."""

    core.bound_batches(docs.sparkSession)

    def run(batches):
        shards = _Shards(base)
        for b in batches:
            rows = []
            for x in b.column(0):
                raw = (x.as_py() or "").encode()
                png = to_png(padded(raw))
                digest = sha256(png).hexdigest()
                shard, at = shards.add(digest, png)
                rows.append((digest, shard, at, len(png), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "digest", "shard", "offset", "length", "n_bytes"])
        shards.close()

    return docs.select(text, id_col).mapInArrow(run, INDEX)


def ranges(b: pa.RecordBatch, base: str, most: int | None = None):
    """(row, stored bytes) of the range that (file, offset, length) name, or its first `most` bytes, in the order of file and offset."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(base)
    shard, offset, length = (b.column(i).to_pylist() for i in range(3))
    name, f, at, data = None, None, -1, b""
    for i in sorted(range(len(b)), key=lambda i: (shard[i], offset[i])):
        n = length[i] if most is None else min(most, length[i])
        if shard[i] != name:
            if f:
                f.close()
            name, f, at = shard[i], files.open_input_file(f"{path}/{shard[i]}"), -1
        if offset[i] != at or len(data) != n:
            f.seek(offset[i])
            at, data = offset[i], f.read(n)
        yield i, data
    if f:
        f.close()


def by_file(index: DataFrame, name: str) -> DataFrame:
    """The written index dealt by file, in order of offset: as many tasks as wrote the files or as there are cores, whatever
    the size of the index itself, and each file opened by one of them."""
    n = max(index.sparkSession.sparkContext.defaultParallelism, index.select(name).distinct().count())
    return index.repartition(n, name).sortWithinPartitions(name, "offset")


def metadata(index: DataFrame, base: str) -> DataFrame:
    """index with width, height, bit_depth and colour_type, by range reads of the headers alone."""
    schema = T.StructType([*index.schema.fields, *(T.StructField(k, T.IntegerType()) for k in ("width", "height", "bit_depth", "colour_type"))])

    def run(batches):
        for b in batches:
            got = [(0, 0, 0, 0)] * len(b)
            for i, data in ranges(b.select(["shard", "offset", "length"]), base, HEADER_BYTES):
                got[i] = header(data)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in got], pa.int32()) for k in range(4))], names=schema.names)

    return index.mapInArrow(run, schema)


def feature(payload: bytes) -> str:
    """Size, mean, share of zero samples and a histogram in 8 bins, of the samples."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};zero={np.count_nonzero(x == 0)};bins={','.join(map(str, bins))}"


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(index: DataFrame, base: str) -> DataFrame:
    """index and what the stored bytes give when read back; a digest that doesn't match is an error. The index may have the columns of `metadata`."""
    schema = T.StructType([*index.schema.fields, *T._parse_datatype_string(READ).fields])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for b in batches:
            out = [None] * len(b)
            digests = b.column("digest").to_pylist()
            known = None
            for i, png in ranges(b.select(["shard", "offset", "length"]), base):
                if known is None or known[0] is not png:
                    if (digest := sha256(png).hexdigest()) != digests[i]:
                        raise ValueError(f"{digests[i]} holds {digest}")
                    payload = from_png(png)
                    known = png, (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), digest, feature(payload))
                out[i] = known[1]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=schema.names)

    return index.mapInArrow(run, schema)
