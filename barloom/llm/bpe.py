"""Byte-level BPE over Arrow batches: encoding with byte and character offsets, and decoding.

The rank file (base64 token, rank) gives the vocabulary; its merges are recovered by splitting each token
with the ranks below its own. The tokenizers library then encodes, with the given pattern as its only
pre-tokeniser and no special tokens, so control strings inside a text are ordinary text.

Nulls: a null text is an empty one (no tokens); a null id is kept. Empty texts give no ids. Repeated rows
give repeated results. Long texts are encoded whole. An empty table gives an empty table. Extra columns
are not read, whatever their names; `keep` names those to carry along.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core

#: Texts that one call of the library gets, in bytes at least.
CALL_BYTES = 1 << 20


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def recover_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token, in order of rank: what is left of it when only earlier merges apply."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = min(joined)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) != 2:
            raise ValueError(f"the ranks give no single last merge for {token!r}")
        out.append((parts[0], parts[1]))
    return out


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers document with these ranks: split by the pattern, map bytes to characters, merge."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_chars()
    text = lambda token: "".join(table[b] for b in token)
    t = Tokenizer(models.BPE(vocab={text(k): v for k, v in ranks.items()}, merges=[(text(a), text(b)) for a, b in recover_merges(ranks)], byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t.to_str()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, document: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(document)
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = json.loads(document)["model"]["vocab"]
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for text, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in text)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def offsets(self, text: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a token inside a character begins or ends within it, so it covers it."""
        ids = np.array(ids, dtype=np.int64)
        end = np.cumsum(self.lengths[ids])
        start = end - self.lengths[ids]
        char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return char[start] - 1, char[end - 1] if len(text) else end

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; bytes of a character that the ids hold only in part become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids):
        """Text after each id; a character that is split over ids comes with the last of them."""
        import codecs

        d = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield d.decode(self.tokens[i])
        yield d.decode(b"", True)


@functools.lru_cache(maxsize=4)
def codec(document: str) -> Codec:
    return Codec(document)


def _encoded(column: pa.Array, c: Codec):
    """(bytes of the text, ids) for each text, some texts at a time."""
    texts = [x if x is not None else "" for x in column.to_pylist()]
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (n < CALL_BYTES or end == at):
            n += len(texts[end])
            end += 1
        for text, ids in zip(texts[at:end], c.encode(texts[at:end])):
            yield text.encode("utf-8"), ids
        at = end


def encode(docs: DataFrame, document: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, ids array<int>, starts and ends array<int> (characters). One scan, no shuffle."""
    core.bound_batches(docs.sparkSession)
    fields = [docs.schema[k] for k in keep]
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*fields, T.StructField("ids", ints), T.StructField("starts", ints), T.StructField("ends", ints)])

    def run(batches):
        c = codec(document)
        for b in batches:
            out = [(ids, *(x.astype(np.int32) for x in c.offsets(raw, ids))) for raw, ids in _encoded(b.column(0), c)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in range(3))], names=schema.names)

    return docs.select(text, *keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, document: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and text; the inverse of encode."""
    schema = T.StructType([*(encoded.schema[k] for k in keep), T.StructField("text", T.StringType())])

    def run(batches):
        c = codec(document)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([None if x is None else c.decode(x) for x in b.column(0).to_pylist()], pa.string())], names=schema.names)

    return encoded.select(ids, *keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, document: str, text: str = "text", id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (bytes that the ids decode to); with ids, those bytes too."""
    core.bound_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())[: 3 + ids]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        c = codec(document)
        for b in batches:
            out = []
            for _, got in _encoded(b.column(0), c):
                raw = np.array(got, dtype="<u4").tobytes()
                out.append((len(got), core.hex_sha256(raw), core.hex_sha256(c.decode_bytes(got)), raw))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], names=names)

    return docs.select(text, id_col).mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def public_document(name: str = "byte_bpe_multi_50k.tiktoken", path: str | None = None) -> str:
    """The tokenizers document of an installed public rank file; path overrides where it lies."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), "rb") as f:
        return model_json(read_ranks(f.read()), public_tokenizers.PATTERN)
