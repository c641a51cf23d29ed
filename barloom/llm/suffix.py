"""Suffix-array dedup of bytes by two-stage sorting.

Of a text's suffixes, only those smaller than their successors are sorted directly, by first byte and then by
the bytes compared. The others follow from one scan of the buckets in order: where suffix j stands, suffix j-1
takes the next place of its own first byte's bucket if it is larger than j. Neighbours' common prefixes, capped
at the length of interest, then show every string of that length that occurs more than once, and in which
documents. Suffixes are ordered up to that length only; beyond it their order doesn't matter here.

A shard's text is the passages that can hold a repeated string; see `repeats` for how they meet there.

Texts are their UTF-8 bytes; no match crosses documents. Nulls: a null text is empty; a null id is smaller than
all. Rows of one id don't remove each other's bytes (none of them has a smaller id), nor does a text its own.
Texts shorter than the length are kept whole. Empty tables give empty tables. A removed run may end inside a
character, so what is left is bytes, not text. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core, repeats

LENGTH, GRAM = 50, 20
#: Bytes that are sorted at once, unless the first occurrences among them are more.
SORTED = 1 << 21


def _next_change(t: np.ndarray) -> np.ndarray:
    """For each position, the first one from there whose byte differs from the byte after it; the last if none."""
    n = len(t)
    at = np.where(np.append(t[1:] != t[:-1], True), np.arange(n, dtype=np.int32), np.int32(n))
    return np.minimum.accumulate(at[::-1])[::-1]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t in the order of their suffixes, compared up to `depth` bytes."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    change = _next_change(t)
    smaller = np.zeros(n, bool)  # suffix i < suffix i+1; the last one is not
    up = change < n - 1
    smaller[up] = t[change[up]] < t[change[up] + 1]
    plain = change - np.arange(n, dtype=np.int32) >= depth  # all of its first `depth` bytes are one byte, and it is larger than its successor
    plain &= ~smaller
    wide = -(-depth // 8) * 8
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([t, np.zeros(wide, np.uint8)]), wide)
    by_byte = np.argsort(t, kind="stable").astype(np.int32)
    cuts = np.searchsorted(t[by_byte], np.arange(257))
    pieces: list[list[np.ndarray]] = [[] for _ in range(256)]
    pieces[t[n - 1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        own = by_byte[cuts[c] : cuts[c + 1]]
        if not len(own):
            continue
        larger = []
        wave = np.concatenate(pieces[c]) if pieces[c] else own[:0]
        wave = wave[~plain[wave]]
        while len(wave):
            larger.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~smaller[before] & ~plain[before]]
        direct = own[smaller[own]]
        if len(direct) > 1:
            keys = windows[direct].view(f"S{wide}").ravel()
            direct = direct[np.argsort(keys, kind="stable")]
        row = np.concatenate([*larger, own[plain[own]], direct])
        out.append(row)
        before = row[row > 0] - 1
        before = before[~smaller[before] & (t[before] > c)]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, edge = before[order], np.searchsorted(first[order], np.arange(257))
        for k in np.unique(first).tolist():
            pieces[k].append(before[edge[k] : edge[k + 1]])
        pieces[c] = []
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, cap at most; neither may end before it."""
    lanes = np.ndarray((len(t) + cap,), "<u8", buffer=np.concatenate([t, np.zeros(cap + 8, np.uint8)]), strides=(1,))
    out = np.full(len(a), cap, np.int32)
    live, x, y = np.arange(len(a), dtype=np.int32), a, b
    for k in range(0, cap, 8):
        d = lanes[x + k] ^ lanes[y + k]
        differ = np.flatnonzero(d)
        first = d[differ]
        first &= ~first + np.uint64(1)  # the lowest bit that differs; those below it, by eights, are equal bytes
        out[live[differ]] = k + (np.bitwise_count(first - np.uint64(1)) >> 3)
        same = np.flatnonzero(d == 0)
        if not len(same):
            break
        live, x, y = live[same], x[same], y[same]
    return np.minimum(out, cap)


def later(items: np.ndarray, bounds: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """True at each byte where a string of `length` bytes starts that also starts in a stretch of a smaller document.

    Stretches are in order of document. A long text is taken in parts, each with the first occurrences of the
    parts before it, so that memory follows the distinct text and not the number of copies.
    """
    if len(items) <= SORTED:
        return _later(items, bounds, doc, length)
    out = np.zeros(len(items), bool)
    kept, kept_bounds, kept_doc = items[:0], np.zeros(1, np.int64), doc[:0]
    at = 0
    while at < len(doc):
        room = max(SORTED // 2, len(kept))
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + room, side="right")) - 1)
        part, shift = items[bounds[at] : bounds[end]], len(kept)
        edges = np.concatenate([kept_bounds, bounds[at + 1 : end + 1] - bounds[at] + shift])
        flags = _later(np.concatenate([kept, part]), edges, np.concatenate([kept_doc, doc[at:end]]), length)[shift:]
        out[bounds[at] : bounds[end]] = flags
        a, z, which = repeats.fresh(bounds[at : end + 1] - bounds[at], flags, length)
        new, new_bounds = repeats.gather(part, a, z)
        kept, kept_bounds = np.concatenate([kept, new]), np.concatenate([kept_bounds, new_bounds[1:] + shift])
        kept_doc = np.concatenate([kept_doc, doc[at:end][which]])
        at = end
    return out


def _later(items: np.ndarray, bounds: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(items), bool)
    if not len(items):
        return out
    sa = suffix_array(items, length)
    which = np.repeat(np.arange(len(doc), dtype=np.int32), np.diff(bounds))
    sa = sa[sa + length <= bounds[1:][which[sa]]]
    if not len(sa):
        return out
    prefix = common_prefixes(items, sa[:-1], sa[1:], length)
    head = np.flatnonzero(np.append(True, prefix < length))
    owner = doc[which[sa]]
    least = np.repeat(np.minimum.reduceat(owner, head), np.diff(np.append(head, len(sa))))
    out[sa[owner > least]] = True
    return out


def kind(length: int = LENGTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(length, min(gram, length), lambda buf, off: (buf, off), later)


def remove_repeats(docs: DataFrame, length: int = LENGTH, blocks: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept binary (the bytes left)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, off = core.flat(left["text"])
        gone = repeats.covered(len(buf), right, length)
        total = np.append(0, np.cumsum(gone))
        begins = gone & ~np.append(False, gone[:-1])
        first = off[:-1][off[:-1] < off[1:]]
        begins[first] = gone[first]  # a run that goes over from one document to the next counts in both
        runs = np.append(0, np.cumsum(begins))
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), left.num_rows, [None, pa.py_buffer((off - total[off]).astype(np.int64)), pa.py_buffer(buf[~gone])]).cast(pa.binary())
        return pa.table({"doc_id": left["doc_id"], "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(total[off[1:]] - total[off[:-1]], pa.int64()), "n_spans": pa.array(runs[off[1:]] - runs[off[:-1]], pa.int64()), "kept": kept})

    return repeats.edit(docs, kind(length), np.uint8, finish, schema, (), blocks, id_col, text)
