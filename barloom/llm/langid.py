"""Language ID by cross-parsing entropy.

Per language, a suffix automaton is built over a bounded sample of labelled text. A document is parsed
against each automaton from left to right into phrases, each the longest match that the automaton has
(a byte that it never saw is a phrase of its own). Few phrases mean a close relation: with c phrases over
a text of m bytes and a sample of n bytes, c * log2(n) / m estimates the cross entropy in bits per byte.
The language with the fewest such normalised phrases wins; ties go to the first name.

The automata become one table of their transitions, rows shifted into each other's gaps, so its size is that of the
transitions (some 12 for 4 bytes of sample), whatever the number of byte values. Many texts advance together. A long
text is read in lanes, all but the first from a guessed state; lanes whose guess was wrong are read again from
the state in which the lane before really ends, until all fit. So the phrases are those of one parse of the whole text.

The classifier's bounds are parameters: `texts` distinct texts per language, the first `chars` characters of each,
`n_bytes` of these per language, `total` for all languages together (with more than total / n_bytes languages each gets
an equal part). Every language is learnt; more than MAX_LANGS distinct labels are an error, not a cut.

Nulls and texts without a letter: `und`, score 0. A row of no known language can't occur otherwise. Empty
tables give empty results; if no row is labelled, every row is `und`. Repeated rows get equal answers. Extra
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

#: Bounds of the sample: texts, characters of each and bytes per language, bytes in all.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_BYTES, TOTAL_BYTES = 64, 1500, 24_000, 8 << 20
MAX_LANGS = 4096
#: Bytes of a lane, and of the texts that are parsed at a time.
LANE, SLICE_BYTES = 2048, 2 << 20
UNKNOWN = "und"


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, n_bytes: int = SAMPLE_BYTES, chars: int = SAMPLE_CHARS, total: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Up to `texts` distinct texts per language, those of smallest hash, each cut to `chars`, to n_bytes together.

    Two light passes: the number of distinct texts per language, then the rows whose hash is low enough for a few times
    the wanted number. Copies count once, so a language of few texts in many rows is learnt like any other.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("x"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("x").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"{lang} has more than {MAX_LANGS} distinct values: these are no languages")
    if not counts:
        return {}
    most = max(1, min(n_bytes, total // len(counts)))
    h = F.shiftrightunsigned("x", 11) / F.lit(float(1 << 53))
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 16.0 * texts / max(1, n))))), F.col("lang"))
    few = rows.where(h < share).groupBy("lang", "x").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy(h, "text")
    few = few.select("lang", "text", F.row_number().over(order).alias("r"), (F.sum(F.octet_length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.octet_length("text") - 1).alias("before"))
    parts: dict[str, list[str]] = {}
    for r in sorted(few.where((F.col("r") <= texts) & (F.col("before") < most)).select("lang", "r", "text").collect()):
        parts.setdefault(r["lang"], []).append(r["text"])
    joined = {k: "\n".join(v).encode()[:most] for k, v in sorted(parts.items())}
    return {k: v for k, v in joined.items() if v}


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence; the first state is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for a in symbols.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and a not in step[p]:
            step[p][a] = new
            p = link[p]
        if p != -1:
            q = step[p][a]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(a) == q:
                    step[p][a] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def interleaved(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each state's row, cells): the transition of state s on symbol a, if it has one, is the cell at place[s] + a.

    A cell is owner << 32 | target, -1 where free. Rows of several transitions, longest first, go where they fit next; the
    many rows of one transition fill the gaps.
    """
    many = sorted((s for s in range(len(step)) if len(step[s]) > 1), key=lambda s: -len(step[s]))
    size = sum(map(len, step)) + 2 * width + 512
    cells = np.full(2 * size, -1, np.int64)
    place, mark, tries = np.zeros(len(step), np.int64), 0, np.arange(512)
    for s in many:
        symbols = np.array(sorted(step[s]))
        at = mark
        while True:
            if at + 512 + width > len(cells):
                cells = np.append(cells, np.full(size, -1, np.int64))
            fits = np.flatnonzero((cells[(at + tries)[:, None] + symbols] < 0).all(axis=1))
            if len(fits):
                break
            at += 512
        place[s] = at + fits[0]
        cells[place[s] + symbols] = s << 32 | np.array([step[s][a] for a in symbols.tolist()])
        mark = at
    one = [(s, *next(iter(step[s].items()))) for s in range(len(step)) if len(step[s]) == 1]
    if one:
        s, a, to = np.array(one).T
        room = width + np.flatnonzero(cells[width:] < 0)
        if len(room) < len(s):
            room = np.append(room, len(cells) + np.arange(len(s)))
            cells = np.append(cells, np.full(len(s), -1, np.int64))
        place[s] = room[: len(s)] - a
        cells[room[: len(s)]] = s << 32 | to
    used = np.flatnonzero(cells >= 0)
    end = max(int(place.max()) + width, int(used[-1]) + 1 if len(used) else 0)
    return place, np.append(cells[:end], np.full(max(0, end - len(cells)), -1, np.int64))


class Parser:
    """Phrase counts of texts against one sample per language."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [k for k, _ in samples]
        raw = [core.lower(np.frombuffer(v, np.uint8)) for _, v in samples]
        seen = np.unique(np.concatenate([*raw, np.zeros(0, np.uint8)]))
        classes = np.zeros(256, np.int64)  # 0: a byte that no sample has
        classes[seen] = np.arange(1, len(seen) + 1)
        classes[65:91] = classes[97:123]
        self.classes, width = classes.astype(np.uint8), len(seen) + 1
        self.bits = np.array([math.log2(max(2, len(x))) for x in raw])
        places, cells, roots, firsts, base, shift = [], [], [], [], 0, 0
        for x in raw:
            step = automaton(self.classes[x])
            place, cell = interleaved(step, width)
            first = np.full(width, base)
            first[list(step[0])] = base + np.array(list(step[0].values()))
            places.append(place + shift)
            cells.append(np.where(cell >= 0, cell + (base << 32 | base), -1))
            roots.append(base)
            firsts.append(first)
            base += len(step)
            shift += len(cell)
        self.place, self.cells = np.concatenate(places).astype(np.int32), np.concatenate(cells)
        self.roots, self.first = np.array(roots, np.int32)[:, None], np.array(firsts, np.int32)

    def _read(self, code, at, left, state) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end in each lane, state after it); lanes come by falling length."""
        count = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-left, -np.arange(int(left[0])), side="left")
        for t in range(len(alive)):
            n = alive[t]
            now, c = state[:, :n], code[at[:n] + t]
            cell = self.cells[self.place[now] + c]
            hit = (cell >> 32) == now
            fresh = self.first[:, c]
            # no such transition: a phrase ends, and the byte begins the next or is one of its own
            count[:, :n] += ~hit & (now != self.roots)
            count[:, :n] += ~hit & (fresh == self.roots)
            state[:, :n] = np.where(hit, cell.astype(np.int32), fresh)
        return count, state

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(texts, languages): phrases of each text."""
        size = np.diff(off)
        parts = -(-size // LANE)
        doc = np.repeat(np.arange(len(size)), parts)
        out = np.zeros((len(size), len(self.langs)), np.int64)
        if not len(doc):
            return out
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = off[:-1][doc] + nth * LANE
        left = np.minimum(off[1:][doc] - at, LANE)
        code = self.classes[buf]
        begin = np.repeat(self.roots, len(doc), axis=1)
        count, end = np.zeros_like(begin), begin.copy()
        todo = np.argsort(-left, kind="stable")
        while len(todo):
            count[:, todo], end[:, todo] = self._read(code, at[todo], left[todo], begin[:, todo])
            real = begin.copy()
            inner = np.flatnonzero(nth)
            real[:, inner] = end[:, inner - 1]
            wrong = np.flatnonzero((real != begin).any(axis=0))
            begin, todo = real, wrong[np.argsort(-left[wrong], kind="stable")]
        last = nth == parts[doc] - 1
        count[:, last] += end[:, last] != self.roots
        np.add.at(out, doc, count.T)
        return out


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, lang_pred, score. score is 1 - (bits of the best language / bits of the second), 0 to 1. One scan, no shuffle."""
    core.bound_batches(docs.sparkSession)
    model = tuple(sorted(samples.items()))
    # the samples' bounds bound the tables that go to the workers
    shared = docs.sparkSession.sparkContext.broadcast(Parser(model) if model else None)
    fields = [T.StructField(k, docs.schema[k].dataType) for k in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter")

    def run(batches):
        core.give_back()
        p = shared.value
        names = np.array([*(p.langs if p else ()), UNKNOWN], dtype=object)
        n_langs = len(names) - 1
        for b in batches:
            buf, off = core.flat(b.column(0))
            lettered = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(b), n_langs), np.zeros(len(b))
            cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, len(buf), SLICE_BYTES)), len(b))) if p else []
            for a, z in zip(cuts[:-1], cuts[1:]):
                n = np.maximum(off[a + 1 : z + 1] - off[a:z], 1)
                bits = p.phrases(buf[off[a] : off[z]], off[a : z + 1] - off[a]) * p.bits / n[:, None]
                first = np.argmin(bits, axis=1)
                rows = np.arange(z - a)
                lowest = bits[rows, first]
                bits[rows, first] = np.inf
                second = bits.min(axis=1) if n_langs > 1 else np.full(z - a, np.inf)
                best[a:z] = first
                score[a:z] = np.where(second > 0, 1 - lowest / np.maximum(second, 1e-300), 0.0)
            best[~lettered] = n_langs
            score[~lettered] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=schema.names)

    return docs.select(text, letter, *keep).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True where crc32 of the id as text leaves the remainder; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
