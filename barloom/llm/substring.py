"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans above a length.

Each shard's reference is the text of repeated passages, in order of document and place. An automaton of the
reference is read along each passage, giving at each word the length of the longest match that ends there
(its matching statistic, no longer than the threshold matters). A word whose statistic reaches the threshold
ends a window that occurs earlier; what matches nowhere joins the reference. So the automaton holds the first
occurrences of a shard only, however many copies pass by. Shards are routed, not broadcast to every task: a
document meets only those shards that can hold one of its windows, so the work grows with the repeated text
and not with documents times shards.

A word is `[^\\x20\\x09-\\x0D]+`, unchanged. Nulls: a null text has no words; a null id sorts first. Texts of
fewer words than the threshold are kept whole. Repeated rows: of rows with one id and text, all but the first
lose their windows. Order among rows of one id: by block, then place in it. Empty tables give empty tables.
Extra columns named in `carry` come back in struct `rest`, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core, repeats

LENGTH, GRAM = 20, 9


class Automaton:
    """A suffix automaton of several sequences, which grows by one symbol at a time."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def extend(self, last: int, a: int) -> int:
        """The state after symbol a, where last is that of the sequence so far (0: a new sequence)."""
        step, link, length = self.step, self.link, self.length
        q = step[last].get(a)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
        else:
            new = -1
        p = last
        while p != -1 and a not in step[p]:
            step[p][a] = new
            p = link[p]
        if p == -1:
            return new
        q = step[p][a]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        twin = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and step[p].get(a) == q:
            step[p][a] = twin
            p = link[p]
        link[q] = twin
        if new == -1:
            return twin
        link[new] = twin
        return new


def later(items: np.ndarray, bounds: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """True at each item where a window starts that also starts in an earlier stretch, or earlier in its own."""
    out = np.zeros(len(items), bool)
    auto = Automaton()
    step, link, size = auto.step, auto.link, auto.length
    symbols = np.unique(items, return_inverse=True)[1].tolist()
    seen: set[bytes] = set()
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        whole = items[a:z].tobytes()
        if whole in seen:  # a stretch seen before has no new window
            out[a : z - length + 1] = True
            continue
        if z - a < 1 << 16:
            seen.add(whole)
        state, match, done, last = 0, 0, a, 0
        for i in range(a, z):
            c = symbols[i]
            to = step[state].get(c)
            while to is None and state:
                state = link[state]
                match = size[state]
                to = step[state].get(c)
            if to is not None:
                state = to
                match += 1
                if match >= length:
                    match = length
                    while size[link[state]] >= length:
                        state = link[state]
                    out[i - length + 1] = True
                    continue
            begin = i - length + 1
            if begin < a:
                continue
            if done < begin:  # the words before belong to known windows only
                done, last = begin, 0
            while done <= i:
                last = auto.extend(last, symbols[done])
                done += 1
            # of what was just added, the longest suffix that also ends elsewhere, so earlier
            state = link[last]
            match = size[state]
    return out


def word_items(buf: np.ndarray, off: np.ndarray):
    core.give_back()
    s, e, at = core.words(buf, off)
    return core.word_hashes(buf, s, e), at


def kind(length: int = LENGTH, gram: int = GRAM) -> repeats.Kind:
    return repeats.Kind(length, min(gram, length), word_items, later)


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), blocks: int | None = None, id_col: str = "doc_id", text: str = "text", keep_unchanged: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans array<struct<start, end>> (words), text (kept words, one space between), rest (columns of carry).

    With keep_unchanged, a text that loses nothing comes back as it was, null included.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("text", T.StringType())]
    if carry:
        fields.append(T.StructField("rest", T.StructType([docs.schema[c] for c in carry])))
    schema = T.StructType(fields)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        buf, off = core.flat(left["text"])
        s, e, at = core.words(buf, off)
        gone = repeats.covered(len(s), right, length)
        n_docs = left.num_rows
        total = np.append(0, np.cumsum(gone))
        kept, kept_off = joined(buf, off, s, e, at, ~gone)
        a, z = repeats.spans(gone)
        doc = np.searchsorted(at, np.arange(len(s)), side="right") - 1
        # a run may go over from one document to the next
        split = at[1:-1][(at[1:-1] < len(s)) & (at[1:-1] > 0)]
        split = split[gone[split] & gone[split - 1]] if len(split) else split
        a, z = np.unique(np.concatenate([a, split])), np.unique(np.concatenate([z, split]))
        of = doc[a] if len(a) else a
        per = np.searchsorted(of, np.arange(n_docs + 1))
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(a - at[of], pa.int32()), pa.array(z - at[of], pa.int32())], ["start", "end"]))
        text = pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string())
        if keep_unchanged:
            same = pa.array(total[at[1:]] == total[at[:-1]])
            text = pc.if_else(same, left["text"].combine_chunks(), text)
        cols = {"doc_id": left["doc_id"], "n_words": pa.array(np.diff(at), pa.int64()), "n_removed": pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), "spans": spans, "text": text}
        if carry:
            cols["rest"] = left["rest"]
        return pa.table(cols)

    return repeats.edit(docs, kind(length), np.uint64, finish, schema, carry, blocks, id_col, text)


def joined(buf, off, s, e, at, keep) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: (bytes, offsets)."""
    edge = np.zeros(len(buf) + 2, np.int8)
    out = np.empty(len(buf) + 1, np.uint8)
    out[:-1] = buf
    ks, ke, ki = s[keep], e[keep], np.flatnonzero(keep)
    doc = np.searchsorted(at, ki, side="right") - 1
    final = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    edge[ks] += 1
    edge[ke[final]] -= 1
    edge[ke[~final] + 1] -= 1
    out[ke[~final]] = 32
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    return out[mask], np.append(0, np.cumsum(mask))[off]
