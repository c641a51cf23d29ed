"""Rolling ranks of one symbol's rows. Runs in Python workers, so it holds no column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd


class Below:
    """How many of the values at positions [l, r) are under a bound, for many ranges at once: a wavelet matrix over places in
    sorted order, one step for each bit of a place. So n ranges cost n log n, however long they are."""

    def __init__(self, places: np.ndarray):
        self.bits = max(1, len(places).bit_length())
        self.zeros = []
        v = places.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            low = (v >> b & 1) == 0
            self.zeros.append(np.append(0, np.cumsum(low)))
            v = np.concatenate([v[low], v[~low]])

    def count(self, l: np.ndarray, r: np.ndarray, bound: np.ndarray) -> np.ndarray:
        out = np.zeros(len(l), np.int64)
        for k, zeros in enumerate(self.zeros):
            high = (bound >> (self.bits - 1 - k) & 1) == 1
            l0, r0 = zeros[l], zeros[r]
            out += np.where(high, r0 - l0, 0)  # all with a 0 here are under a bound with a 1
            l, r = np.where(high, zeros[-1] + l - l0, l0), np.where(high, zeros[-1] + r - r0, r0)
        return out


def rolling_rank(x: np.ndarray, n: int, least: int) -> np.ndarray:
    """The share of the last n values that each one's rank (average of ties) makes up; NaN where it is missing or fewer than
    `least` of the n are there."""
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(x == x)
    v = x[at]
    if not len(v):
        return out
    order = np.argsort(v, kind="stable")
    places = np.empty(len(v), np.int64)
    places[order] = np.arange(len(v))
    below = Below(places)
    l, r = np.searchsorted(at, at - n + 1), np.arange(1, len(v) + 1)
    under = below.count(l, r, np.searchsorted(v[order], v, "left"))
    to = below.count(l, r, np.searchsorted(v[order], v, "right"))
    size = r - l
    out[at] = np.where(size >= least, (under + (to - under + 1) / 2) / size, np.nan)
    return out


def ranker(column: str, name: str, n: int, least: int):
    """A function from one symbol's rows to the same rows, by date, with rolling_rank of a column."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("d", ignore_index=True)
        return p.assign(**{name: rolling_rank(p[column].to_numpy(float), n, least)})

    return run
