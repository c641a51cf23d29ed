"""Tree-structured Parzen estimators: parameters for the next trial from those of the trials so far.

Trials are split into the best share and the rest. Each parameter has a density for either part: a mixture of a bell around each
tried value, as wide as the gap to its neighbours, and a flat prior; for choices, counts with the prior added. Candidates are
drawn from the density of the good ones, and the one with the largest ratio of good to bad density is tried next. All draws are seeded.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass


@dataclass(frozen=True)
class Choice:
    """One of some values without an order."""

    values: tuple

    def draw(self, rng: random.Random):
        return rng.choice(self.values)


@dataclass(frozen=True)
class Span:
    """A number from low to high; log: even in its logarithm; whole: rounded."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, v: float) -> float:
        return math.log(v) if self.log else float(v)

    def outer(self, x: float):
        v = min(self.high, max(self.low, math.exp(x) if self.log else x))
        return int(round(v)) if self.whole else v

    @property
    def bounds(self) -> tuple[float, float]:
        return self.inner(self.low), self.inner(self.high)

    def draw(self, rng: random.Random):
        return self.outer(rng.uniform(*self.bounds))


Space = dict[str, Choice | Span]


def _cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


class Density:
    """Of one parameter, from the values that were tried."""

    def __init__(self, of: Choice | Span, tried: list):
        self.of = of
        if isinstance(of, Choice):
            self.weights = [1 + sum(v == t for t in tried) for v in of.values]
            return
        low, high = of.bounds
        self.low, self.high = low, high
        at = sorted(of.inner(t) for t in tried)
        least, width = (high - low) / min(100.0, 1.0 + len(at)), high - low
        self.bells = []
        for i, x in enumerate(at):
            left, right = x - (at[i - 1] if i else low), (at[i + 1] if i + 1 < len(at) else high) - x
            wide = min(width, max(least, left, right)) or 1.0
            self.bells.append((x, wide, max(_cdf((high - x) / wide) - _cdf((low - x) / wide), 1e-300)))

    def draw(self, rng: random.Random):
        if isinstance(self.of, Choice):
            return rng.choices(self.of.values, self.weights)[0]
        i = rng.randrange(len(self.bells) + 1)  # the last is the prior
        if i == len(self.bells):
            return self.of.draw(rng)
        x, wide, _ = self.bells[i]
        for _ in range(100):
            got = rng.gauss(x, wide)
            if self.low <= got <= self.high:
                return self.of.outer(got)
        return self.of.outer(x)

    def log(self, value) -> float:
        if isinstance(self.of, Choice):
            return math.log(self.weights[self.of.values.index(value)] / sum(self.weights))
        x, n = self.of.inner(value), len(self.bells) + 1
        flat = 1 / (self.high - self.low) if self.high > self.low else 1.0
        bells = sum(math.exp(-0.5 * ((x - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * mass) for m, w, mass in self.bells)
        return math.log((flat + bells) / n)


def suggest(space: Space, trials: list[tuple[dict, float | None]], rng: random.Random, first: int = 5, good: float = 0.25, candidates: int = 24) -> dict:
    """Parameters for the next trial. trials: (parameters, score), larger is better, None for those that failed; the `first` are drawn evenly."""
    if len(trials) < first:
        return {k: s.draw(rng) for k, s in space.items()}
    order = sorted(trials, key=lambda t: -math.inf if t[1] is None else t[1], reverse=True)
    n = max(1, math.ceil(good * len(order)))
    best, rest = ({k: Density(s, [t[0][k] for t in part]) for k, s in space.items()} for part in (order[:n], order[n:]))
    drawn = [{k: d.draw(rng) for k, d in best.items()} for _ in range(candidates)]
    return max(drawn, key=lambda c: sum(best[k].log(v) - rest[k].log(v) for k, v in c.items()))
