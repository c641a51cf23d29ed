"""Properties of the pieces that run in Python workers, on generated input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import core, katz, media, packing, repeats, substring, suffix

texts = st.lists(st.text(alphabet="ab \n\té🤖", max_size=40), max_size=8)


def flat(xs):
    raw = [x.encode() for x in xs]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(xs):
    import re

    buf, off = flat(xs)
    s, e, at = core.words(buf, off)
    got = [[buf[a:b].tobytes() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(at[:-1], at[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", x.encode()) for x in xs]
    kept, kept_off = substring.joined(buf, off, s, e, at, np.ones(len(s), bool))
    assert [kept[i:j].tobytes() for i, j in zip(kept_off[:-1], kept_off[1:])] == [b" ".join(w) for w in got]
    h = core.word_hashes(buf, s, e)
    assert len(np.unique(h)) == len({w for x in got for w in x})


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_ngrams_tell_runs_apart(xs, k):
    h = core.ngrams(core.BYTES[np.array(xs, np.uint8)], k)
    runs = [tuple(xs[i : i + k]) for i in range(len(xs) - k + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))
    assert {(a == b) == (x == y) for a, x in zip(h.tolist(), runs) for b, y in zip(h.tolist(), runs)} <= {True}


@given(st.lists(st.binary(min_size=3, max_size=30), min_size=1, max_size=8), st.integers(2, 6))
@settings(max_examples=200, deadline=None)
def test_suffix_pass_equals_brute_force(parts, size):
    parts = [bytes(b % 3 + 97 for b in p) for p in parts]
    bounds = np.append(0, np.cumsum([len(p) for p in parts]))
    got = suffix.later(np.frombuffer(b"".join(parts), np.uint8), bounds, np.arange(len(parts)), size)
    first = {}
    for d, p in enumerate(parts):
        for i in range(len(p) - size + 1):
            first.setdefault(p[i : i + size], d)
    want = [i + size <= len(p) and first[p[i : i + size]] < d for d, p in enumerate(parts) for i in range(len(p))]
    assert got.tolist() == want


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packed_rows_never_overflow(sizes):
    rows = packing.best_fit(np.array(sizes, np.int64), 50)
    if sizes:
        fill = np.bincount(rows, weights=sizes)
        assert fill.max() <= 50 and len(fill) == rows.max() + 1 and fill.min() > 0
        assert sum(f <= 25 for f in fill) <= 1  # two half-empty rows would have been one


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.lists(st.binary(max_size=20), max_size=4))
@settings(max_examples=100, deadline=None)
def test_packed_arrays_come_back(xs, blobs):
    assert katz.unplanes(katz.planes(np.array(xs, np.int64))).tolist() == xs
    arrays = [np.frombuffer(b, np.uint8) for b in blobs]
    assert [a.tobytes() for a in repeats.unpack(repeats.pack(*arrays), *[np.uint8] * len(arrays))] == blobs


@given(st.binary(max_size=500))
@settings(max_examples=100, deadline=None)
def test_images_come_back(raw):
    png = media.to_png(media.padded(raw))
    assert media.from_png(png) == media.padded(raw) and media.header(png)[:2] == (64, len(media.padded(raw)) // 64)


@given(st.lists(st.integers(0, 1000), min_size=6, max_size=6))
@settings(max_examples=200, deadline=None)
def test_discounts_keep_counts_positive(counts):
    d = katz.discounts(np.array(counts, float))
    assert len(d) == 6 and (d[1:] > 0).all() and (d[1:] < 1).all()
