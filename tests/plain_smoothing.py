"""Recursive smoothing one bar at a time: what the scan of affine maps is tested against.

A measure takes a bar at a time and gives its value there, NaN through the warm-up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

NAN = math.nan


class Level:
    """A decaying mean. The first `warm` rows count evenly, later ones with weight alpha against all before.

    A missing value leaves the level where it is, and the level's own weight fades meanwhile. Nothing shows before the
    warm rows are over and `least` values came.
    """

    __slots__ = ("alpha", "warm", "least", "rows", "values", "level", "weight")

    def __init__(self, alpha: float, warm: int = 1, least: int = 1):
        self.alpha, self.warm, self.least = alpha, warm, least
        self.rows, self.values, self.level, self.weight = 0, 0, 0.0, 0.0

    def step(self, x: float) -> float:
        self.rows += 1
        if x == x:
            self.values += 1
            if self.rows <= self.warm:
                gain = 1 / self.values
            else:
                gain = self.alpha / (self.alpha + (1 - self.alpha) * self.weight)
            self.level += gain * (x - self.level)
            self.weight = 1.0
        elif self.rows > self.warm:
            self.weight *= 1 - self.alpha
        return self.level if self.rows >= self.warm and self.values >= self.least else NAN


def wilder(n: int = 14) -> Level:
    return Level(1 / n, warm=n)


def spanned(span: int) -> Level:
    return Level(2 / (span + 1), least=span)


# Each maker gives a function from (high, low, close, and those of the row before, NaN in the first) to the measure's value.


def ema(span: int) -> Callable:
    mean = spanned(span)
    return lambda h, l, c, h0, l0, c0: mean.step(c)


def macd() -> Callable:
    fast, slow = spanned(12), spanned(26)
    return lambda h, l, c, h0, l0, c0: fast.step(c) - slow.step(c)


def macd_signal() -> Callable:
    line, mean = macd(), spanned(9)
    return lambda *bar: mean.step(line(*bar))


def rsi() -> Callable:
    """50 where nothing moved, 100 where nothing fell. The first row has no move and is no part of the warm-up."""
    gains, losses, begun = wilder(), wilder(), False

    def value(h, l, c, h0, l0, c0):
        nonlocal begun
        if not begun:
            begun = True
            return NAN
        rise = c - c0
        g, f = gains.step(rise if not rise < 0 else 0.0), losses.step(-rise if not rise > 0 else 0.0)
        if f == 0:
            return 50.0 if g == 0 else 100.0
        return 100 * g / (g + f)

    return value


def reach(h, l, c, h0, l0, c0) -> float:
    """True range: what today's range and yesterday's close span; NaN parts are left out."""
    spans = [x for x in (h - l, abs(h - c0), abs(l - c0)) if x == x]
    return max(spans, default=NAN)


def atr() -> Callable:
    mean = wilder()
    return lambda *bar: mean.step(reach(*bar))


def adx() -> Callable:
    """The share of one-sided movement, smoothed twice. Both directions are over one average range, which cancels out.

    The second mean counts its warm rows from the first bar, when there is no share yet: it begins with the first share alone.
    """
    ups, downs, shares = wilder(), wilder(), wilder()

    def value(h, l, c, h0, l0, c0):
        rise, fall = h - h0, l0 - l
        u, d = ups.step(rise if rise > fall and rise > 0 else 0.0), downs.step(fall if fall > rise and fall > 0 else 0.0)
        return shares.step(100 * abs(u - d) / (u + d) if u + d > 0 else NAN)

    return value


#: What each named column is made by.
SMOOTHINGS = {"ema_20": lambda: ema(20), "ema_50": lambda: ema(50), "ema_200": lambda: ema(200), "macd": macd, "macd_signal": macd_signal, "rsi_14": rsi, "atr_14": atr, "adx_14": adx}


def column(name: str, bars: list[tuple[float, float, float]]) -> list[float]:
    """A measure's values for (high, low, close) in order of date."""
    f, before, out = SMOOTHINGS[name](), (NAN, NAN, NAN), []
    for bar in bars:
        out.append(f(*bar, *before))
        before = bar
    return out
