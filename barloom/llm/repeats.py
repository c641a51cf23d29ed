"""Windows of documents that also occur earlier in the corpus: the exchange that substring and suffix dedup share.

A document is a sequence of items (word hashes, or bytes); a window is `length` consecutive items. Two equal
windows have the same smallest hash over their runs of `gram` items, their anchor; so windows whose anchor
occurs once in the corpus occur once, and only about 2 / (length - gram + 2) of the positions are sent:

1. each block sends its distinct anchors to their buckets (a marked one occurs more than once in the block);
2. a bucket answers which anchors are repeated, and the shard where their windows meet: that of the first
   document that has the anchor;
3. a block cuts its documents into stretches of windows whose anchors are repeated and go to one shard.
   Those with a repeat in the block pass `later`, the operator's own method, at once; what is known to be a
   repeat stays, and only first occurrences go on. So a passage that a third of all rows hold is sent once
   per block;
4. a shard orders the stretches that it gets, passes them through `later` again, and tells each block. What more than
   GROUP blocks have goes to a shard for each GROUP of them first, and only first occurrences go on from there, so a passage
   that every block holds doesn't fill one task;
5. a block takes all answers and edits its documents.

There are fewer buckets than blocks, as a bucket gets a fraction of the text: the messages are blocks times buckets.

All of it is one lazy plan: the exchange of the texts is made once and read three times. Items are named by their
place in the block, so each step puts the block's rows in one order first, whatever order they are fetched in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core

U = np.uint64
#: Bytes of text in a block here: what is derived of each byte or word is many times as large.
BLOCK_BYTES = 8 << 20
#: Items of which anchors are sought at a time.
PIECE = 1 << 21
#: Blocks whose copies of a passage meet in one task.
GROUP = 256


@dataclass(frozen=True)
class Kind:
    """length and gram: items in a window and in an anchor; items: (buf, off) -> (items, index of each document's first);
    later: (items, bounds, documents, length) -> True at each window start that is a repeat, for stretches in order."""

    length: int
    gram: int
    items: Callable
    later: Callable


def anchors_of(items: np.ndarray, at: np.ndarray, kind: Kind):
    """(anchor of each window, window starts that lie in one document, anchors' own positions), piece by piece.

    Yields (first position, anchors of the windows from there, mask of positions that are an anchor, their hashes).
    """
    size, span, n = kind.length, kind.length - kind.gram + 1, len(items)
    begins = np.searchsorted(at, np.arange(0, max(1, n - size + 1), PIECE), side="right") if n else []
    for k in range(len(begins)):
        a = k * PIECE
        z = min(n, a + PIECE + size - 1)
        if z - a < size:
            break
        lo = max(0, a - span + 1) if k else 0  # windows before that share positions
        part = items[lo:z]
        h = core.ngrams(part if part.dtype == np.uint64 else core.BYTES[part], kind.gram)
        m = core.window_min(h, span)
        ok = np.zeros(len(m) + size, np.int32)
        cut = at[(at > lo) & (at < z)] - lo  # a window that starts in the size - 1 items before a cut crosses it
        np.add.at(ok, np.maximum(cut - size + 1, 0), 1)
        np.add.at(ok, cut, -1)
        inside = np.cumsum(ok[: len(m)]) == 0
        m = np.where(inside, m, U(0))
        grown = np.concatenate([np.zeros(span - 1, np.uint64), m, np.zeros(span - 1, np.uint64)])
        own = ~core.window_min(~grown, span)[: len(h)] == h
        own[: a - lo] = False
        yield a, m[a - lo :], inside[a - lo :], np.flatnonzero(own) + lo, h[own]


def named(h: np.ndarray) -> np.ndarray:
    """48-bit names of anchors, spread evenly."""
    return core.mix(h.copy()) >> U(16)


def bucket_cuts(names: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n buckets, equal ranges of names, in sorted names."""
    edges = (np.arange(n + 1, dtype=object) * (1 << 48) // n).astype(np.uint64)
    return np.searchsorted(names, edges)


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(x.tobytes()) for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)])


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _block_names(items, at, kind):
    """Sorted distinct names of a block's anchors, how often each occurs, and the first document that has it."""
    got = [(named(h), pos) for _, _, _, pos, h in anchors_of(items, at, kind)]
    if not got:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z
    names, first, count = np.unique(np.concatenate([x[0] for x in got]), return_index=True, return_counts=True)
    return names, count, np.searchsorted(at, np.concatenate([x[1] for x in got])[first], side="right") - 1


def ask(kind: Kind, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        t = core.ordered(t)
        items, at = kind.items(*core.flat(t["text"]))
        names, count, doc = _block_names(items, at, kind)
        cuts = bucket_cuts(names, buckets)
        full = np.flatnonzero(np.diff(cuts))
        blobs = [pack((n := names[cuts[b] : cuts[b + 1]]).astype(np.uint32), (n >> U(32)).astype(np.uint16), np.packbits(count[cuts[b] : cuts[b + 1]] > 1), doc[cuts[b] : cuts[b + 1]].astype(np.uint32)) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), t["block"][0].as_py()), pa.int32()), "data": pa.array(blobs, pa.binary())})

    return run


def answer(shards: int):
    def run(t: pa.Table) -> pa.Table:
        block = t["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        names, marks, first, which = [], [], [], []
        for i in order:
            lo, hi, bits, doc = unpack(t["data"][int(i)].as_py(), np.uint32, np.uint16, np.uint8, np.uint32)
            names.append(lo.astype(np.uint64) | (hi.astype(np.uint64) << U(32)))
            marks.append(np.unpackbits(bits, count=len(lo)).astype(bool))
            first.append(doc)
            which.append(np.full(len(lo), block[i], np.int64))
        sizes = np.array([len(x) for x in names])
        names, marks, first, which = (np.concatenate(x) for x in (names, marks, first, which))
        by = np.argsort(names, kind="stable")  # in a run, the lowest block comes first
        s = names[by]
        new = np.append(True, s[1:] != s[:-1])
        run_of = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        repeated = (np.diff(np.append(head, len(s))) > 1) | np.logical_or.reduceat(marks[by], head)
        lead = core.mix((which[by][head].astype(np.uint64) << U(32)) | first[by][head].astype(np.uint64))
        shard = np.empty(len(s), np.int64)
        shard[by] = np.where(repeated, (lead % U(shards)).astype(np.int64), -1)[run_of]
        wide = np.empty(len(s), bool)
        wide[by] = (np.diff(np.append(head, len(s))) > GROUP)[run_of]
        # by way of the shard of a group of blocks
        shard[wide] += shards * (1 + which[wide] // GROUP)
        blobs, cuts = [], np.append(0, np.cumsum(sizes))
        for a, z in zip(cuts[:-1], cuts[1:]):
            hit = np.flatnonzero(shard[a:z] >= 0)
            blobs.append(pack(hit.astype(np.uint32), shard[a:z][hit].astype(np.uint32)))
        return pa.table({"block": pa.array(block[order], pa.int32()), "bucket": pa.array([t["bucket"][0].as_py()] * len(order), pa.int32()), "data": pa.array(blobs, pa.binary())})

    return run


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gather(items: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """items of the ranges, one after another, and their bounds."""
    size = end - start
    bounds = np.append(0, np.cumsum(size))
    index = np.repeat((start - bounds[:-1]).astype(np.int32), size)
    index += np.arange(bounds[-1], dtype=np.int32)
    return items[index], bounds


def _repeats(items, bounds, doc, pos, kind):
    """later() for stretches in any order; the flag of each item as the start of a window."""
    order = np.lexsort((pos, doc))
    if (order[1:] < order[:-1]).any():
        moved, new = gather(items, bounds[:-1][order], bounds[1:][order])
        flags = kind.later(moved, new, doc[order], kind.length)
        out = np.empty(len(items), bool)
        back, _ = gather(np.arange(len(items), dtype=np.int32), bounds[:-1][order], bounds[1:][order])
        out[back] = flags
        return out
    return kind.later(items, bounds, doc, kind.length)


def cut(kind: Kind, buckets: int):
    """Step 3: rows (dest, block, data): dest is a shard's number, or -1 - block for what the block knows itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dest, blobs = [], []
        block = left["block"][0].as_py() if left.num_rows else -1
        if left.num_rows and right.num_rows:
            left = core.ordered(left)
            items, at = kind.items(*core.flat(left["text"]))
            names, count, _ = _block_names(items, at, kind)
            cuts = bucket_cuts(names, buckets)
            hit, shard = [], []
            for b, data in zip(right["bucket"].to_pylist(), right["data"].to_pylist()):
                i, s = unpack(data, np.uint32, np.uint32)
                hit.append(i.astype(np.int64) + cuts[b])
                shard.append(s.astype(np.int64))
            hit, shard = np.concatenate(hit), np.concatenate(shard)
            by = np.argsort(hit)
            hit, shard = hit[by], shard[by]
            known, inner = names[hit], count[hit] > 1
            to = np.full(len(items), -1, np.int32)
            near = np.zeros(len(items), bool)
            for a, m, inside, _, _ in anchors_of(items, at, kind):
                turn = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                name = named(m[turn])
                i = np.minimum(np.searchsorted(known, name), max(len(known) - 1, 0))
                good = (known[i] == name) if len(known) else np.zeros(len(turn), bool)
                length = np.diff(np.append(turn, len(m)))
                to[a : a + len(m)] = np.where(inside, np.repeat(np.where(good, shard[i] if len(known) else -1, -1), length), -1)
                near[a : a + len(m)] = np.repeat(good & (inner[i] if len(known) else good), length)
            doc_of = core.owners(at).astype(np.int32)
            ids = core.ids(left["doc_id"])
            start, end = spans(to >= 0)
            if len(start):
                # split at a new shard or document
                turn = np.flatnonzero((to[1:] != to[:-1]) | (doc_of[1:] != doc_of[:-1])) + 1
                start = np.unique(np.concatenate([start, turn[to[turn] >= 0]]))
                stop = np.append(turn, len(to))
                end = stop[np.searchsorted(stop, start, side="right")]
                close = np.add.reduceat(near, start) > 0
                sent = to >= 0
                s, e = start[close], end[close]
                if len(s):
                    part, bounds = gather(items, s, e + kind.length - 1)
                    flags = _repeats(part, bounds, ids[doc_of[s]], s, kind)
                    where, _ = gather(np.arange(len(items) + kind.length, dtype=np.int32), s, e + kind.length - 1)
                    known_repeat = np.zeros(len(items), bool)
                    known_repeat[where[flags]] = True
                    sent &= ~known_repeat
                    a, z = spans(known_repeat)
                    dest.append(-1 - block)
                    blobs.append(pack(a.astype(np.int64), z.astype(np.int64)))
                turn = np.flatnonzero(sent & np.append(True, (~sent[:-1]) | (to[1:] != to[:-1]) | (doc_of[1:] != doc_of[:-1])))
                stop = np.flatnonzero(np.append((sent[:-1] & ((~sent[1:]) | (to[1:] != to[:-1]) | (doc_of[1:] != doc_of[:-1]))), sent[-1:])) + 1
                order = np.argsort(to[turn], kind="stable")
                turn, stop = turn[order], stop[order]
                which = to[turn]
                edges = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else []
                for a, z in zip(edges, np.append(edges[1:], len(which)) if len(which) else []):
                    part, bounds = gather(items, turn[a:z], stop[a:z] + kind.length - 1)
                    dest.append(int(which[a]))
                    blobs.append(pack(ids[doc_of[turn[a:z]]], turn[a:z].astype(np.int64), np.diff(bounds), part))
        return pa.table({"dest": pa.array(dest, pa.int64()), "block": pa.array([block] * len(dest), pa.int32()), "data": pa.array(blobs, pa.binary())})

    return run


def fresh(bounds: np.ndarray, flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, stretch) of what is left of stretches when windows with a flag go: runs of window starts, with their last window."""
    n = len(flags)
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = ~flags & (np.arange(n) + length <= bounds[1:][which])
    turn = np.append(True, which[1:] != which[:-1])[:n]
    a = np.flatnonzero(good & (turn | ~np.append(False, good[:-1])[:n]))
    z = np.flatnonzero(good & (np.append(turn[1:], True)[:n] | ~np.append(good[1:], False)[:n])) + length
    return a, z, which[a]


def settle(kind: Kind, item_type, shards: int):
    """Step 4: rows (dest, block, data). dest -1 - block: spans of window starts that are repeats, as positions in the block;
    else first occurrences within a group of blocks, on their way to their shard."""

    def run(t: pa.Table) -> pa.Table:
        blocks, data, at = t["block"].to_pylist(), t["data"].to_pylist(), t["dest"][0].as_py()
        if at < 0:
            return t.select(["dest", "block", "data"])
        dest, out, blobs = [], [], []
        order = sorted(range(len(blocks)), key=lambda i: blocks[i])
        got = [unpack(data[i], np.int64, np.int64, np.int64, item_type) for i in order]
        doc, pos, size, items = (np.concatenate([x[k] for x in got]) for k in range(4))
        bounds = np.append(0, np.cumsum(size))
        flags = _repeats(items, bounds, doc, np.arange(len(doc)), kind)
        place = np.repeat(pos - bounds[:-1], size) + np.arange(len(items))
        k = n = 0
        for i, x in zip(order, got):
            part = slice(k, k + len(x[3]))
            hit = np.sort(place[part][flags[part]])
            new = np.flatnonzero(np.append(True, np.diff(hit) > 1)) if len(hit) else hit
            dest.append(-1 - blocks[i])
            out.append(blocks[i])
            blobs.append(pack(hit[new], hit[np.append(new[1:], len(hit)) - 1] + 1 if len(hit) else hit))
            if at >= shards:
                own = bounds[n : n + len(x[2]) + 1] - bounds[n]
                a, z, which = fresh(own, flags[part], kind.length)
                if len(a):
                    rest, edges = gather(x[3], a, z)
                    dest.append(at % shards)
                    out.append(blocks[i])
                    blobs.append(pack(x[0][which], x[1][which] + a - own[:-1][which], np.diff(edges), rest))
            k, n = part.stop, n + len(x[2])
        return pa.table({"dest": pa.array(dest, pa.int64()), "block": pa.array(out, pa.int32()), "data": pa.array(blobs, pa.binary())})

    return run


def covered(n: int, right: pa.Table, length: int) -> np.ndarray:
    """Items that a window which is a repeat covers."""
    edge = np.zeros(n + 1, np.int32)
    for data in right["data"].to_pylist():
        a, z = unpack(data, np.int64, np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, z + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def edit(docs: DataFrame, kind: Kind, item_type, finish, schema: T.StructType, carry: tuple[str, ...], n: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs through steps 1 to 5; finish(table of the block, covered items) makes the rows. carry names further columns, in struct `rest`."""
    from pyspark.sql import functions as F

    n = n or core.block_count(docs, text, BLOCK_BYTES)
    b = core.blocks(docs, n, id_col, text)
    if carry:
        b = docs.select(F.pmod(F.xxhash64(id_col, text), F.lit(n)).cast("int").alias("block"), F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*carry).alias("rest"))
    groups, buckets, shards = b.groupBy("block"), -(-n // 4), 2 * n
    there, back = core.Relay("block", "bucket", n, buckets, "bucket int, block int, data binary"), core.Relay("bucket", "block", buckets, n, "block int, bucket int, data binary", on=n > core.RELAY)
    asked, answers, cuts = there.send(groups, ask(kind, buckets)), answer(shards), cut(kind, buckets)
    told = back.send(asked.groupBy("bucket"), lambda t: answers(there.opened(t)))
    known = groups.cogroup(told.groupBy("block")).applyInArrow(lambda left, right: cuts(left, back.opened(right)), "dest long, block int, data binary")
    for _ in range(1 + (n > GROUP)):
        known = known.groupBy("dest").applyInArrow(settle(kind, item_type, shards), "dest long, block int, data binary")
    return groups.cogroup(known.groupBy("block")).applyInArrow(lambda left, right: finish(core.ordered(left), right), schema)
