"""Decaying means (exponential and Wilder smoothing) as a scan of affine maps, in window expressions alone.

A step takes a level to a * level + b: a bar with a value decays what was there and adds its share, a bar without one leaves
the level as it is. Such maps compose, (a, b) then (c, d) being (a c, c b + d), so a history is cut into chunks: within a chunk
the composition of all steps so far is the product P of their a, with P * sum(b / P) as its b; over chunks, the maps of whole
chunks are folded into the level with which a chunk begins. A row's level is then P * (begin + sum(b / P)).

P falls by 1 - alpha a row, so a chunk has only so many rows that P stays far within a double's range. The sum grows as P
falls, so its latest terms weigh most and nothing cancels out: levels agree with step-by-step ones to a few units of the last place.

Chunks follow the dates, so all windows after the first sort share one ordering, and no exchange is added to the one by symbol.
A row carries the maps of the chunks before its own: one for some 1800 rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import by

#: P stays over exp(-NATS) in a chunk.
NATS, CHUNK = 400, 2048


@dataclass(frozen=True)
class Mean:
    """The first `warm` rows count evenly, later values with weight alpha against all before.

    A missing value leaves the level where it is, and the weight of what was there fades meanwhile. Nothing shows before the
    warm rows are over and `least` values came. `skip` rows at a symbol's beginning are no part of it.
    """

    alpha: float
    warm: int = 1
    least: int = 1
    skip: int = 0


def wilder(n: int = 14, skip: int = 0) -> Mean:
    return Mean(1 / n, warm=n, skip=skip)


def spanned(span: int) -> Mean:
    return Mean(2 / (span + 1), least=span)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def numbered(df: DataFrame, means: list[Mean]) -> DataFrame:
    """df with |row (from 1 in each symbol, by date) and |chunk, whose rows suit all the means."""
    rows = min([CHUNK, *(int(NATS / -math.log1p(-m.alpha)) for m in means)])
    return df.withColumn("|row", F.row_number().over(by())).withColumn("|chunk", F.floor((_c("|row") - 1) / F.lit(max(1, rows))))


def levels(df: DataFrame, means: dict[str, tuple[Column, Mean]]) -> DataFrame:
    """df of `numbered` with a column for each name: the decaying mean of an expression. All means share their windows."""
    ordered = Window.partitionBy("symbol").orderBy(_c("|chunk"), "d")
    so_far, before = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("symbol", _c("|chunk")).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    kept = df.columns
    row = {k: _c("|row") - m.skip for k, (_, m) in means.items()}
    # a missing value is NULL, also where it is NaN or before the mean begins
    df = df.withColumns({f"{k}|x": F.when((row[k] > 0) & ~F.isnan(x.cast("double")), x.cast("double")) for k, (x, _) in means.items()})
    df = df.withColumns({
        name: made for k, (_, m) in means.items() for name, made in {
            f"{k}|n": F.count(_c(f"{k}|x")).over(so_far), f"{k}|last": F.max(F.when(_c(f"{k}|x").isNotNull(), row[k])).over(before),
            **({f"{k}|even": F.avg(_c(f"{k}|x")).over(ordered.rowsBetween(1 - m.warm, 0))} if m.warm > 1 else {}),
        }.items()
    })
    steps = {}
    for k, (_, m) in means.items():
        x, a, after = _c(f"{k}|x"), m.alpha, row[k] > m.warm
        begun, passed = _c(f"{k}|last").isNotNull(), row[k] - 1 - F.greatest(_c(f"{k}|last"), F.lit(m.warm))
        faded = F.when(passed > 0, F.pow(F.lit(1 - a), passed)).otherwise(1.0)
        share = a + (1 - a) * faded
        decays, adds = F.when(passed > 0, (1 - a) * faded / share).otherwise(1 - a), F.when(passed > 0, a / share).otherwise(a)
        steps[f"{k}|a"] = F.when(after & begun & x.isNotNull(), decays).otherwise(1.0)
        first = _c(f"{k}|even") if m.warm > 1 else x
        steps[f"{k}|b"] = F.coalesce(F.when(after, F.when(begun, adds * x).otherwise(x)).when(row[k] == m.warm, first), F.lit(0.0))
    df = df.withColumns(steps)
    df = df.withColumns({f"{k}|p": F.product(_c(f"{k}|a")).over(inside) for k in means})
    df = df.withColumns({f"{k}|s": F.sum(_c(f"{k}|b") / _c(f"{k}|p")).over(inside) for k in means})
    # at a chunk's first row, the map of the chunk before
    new = _c("|chunk") > F.lag(_c("|chunk")).over(ordered)
    df = df.withColumns({f"{k}|map": F.when(new, F.struct(F.lag(_c(f"{k}|p")).over(ordered).alias("p"), F.lag(_c(f"{k}|s")).over(ordered).alias("s"))) for k in means})
    df = df.withColumns({f"{k}|maps": F.collect_list(_c(f"{k}|map")).over(so_far) for k in means})
    out = {}
    for k, (_, m) in means.items():
        begin = F.aggregate(_c(f"{k}|maps"), F.lit(0.0), lambda level, x: x["p"] * (level + x["s"]))
        out[k] = F.when((row[k] >= m.warm) & (_c(f"{k}|n") >= m.least), _c(f"{k}|p") * (begin + _c(f"{k}|s")))
    return df.select(*map(_c, kept), *(c.alias(k) for k, c in out.items()))


def _rise() -> Column:
    return _c("|close") - _c("|close0")


def _true_range() -> Column:
    """What today's range and yesterday's close span; missing parts are left out."""
    h, l, c0 = _c("|high"), _c("|low"), _c("|close0")
    return F.greatest(h - l, F.abs(h - c0), F.abs(l - c0))


def _moves() -> tuple[Column, Column]:
    """Upward and downward movement of the range, of which one is 0."""
    up, down = _c("|high") - _c("|high0"), _c("|low0") - _c("|low")
    return F.when((up > down) & (up > 0), up).otherwise(0.0), F.when((down > up) & (down > 0), down).otherwise(0.0)


#: What each measure smooths: input columns, and the means that it needs by name. Names in common are made once.
MEASURES: dict[str, tuple[tuple[str, ...], dict]] = {
    **{f"ema_{n}": (("close",), {f"|ema{n}": (lambda: _c("|close"), spanned(n))}) for n in (20, 50, 200)},
    **{k: (("close",), {f"|ema{n}": (lambda: _c("|close"), spanned(n)) for n in (12, 26)}) for k in ("macd", "macd_signal")},
    "rsi_14": (("close",), {"|gain": (lambda: F.when(_rise() < 0, 0.0).otherwise(_rise()), wilder(14, 1)), "|loss": (lambda: F.when(_rise() > 0, 0.0).otherwise(-_rise()), wilder(14, 1))}),
    "atr_14": (("high", "low", "close"), {"|range": (_true_range, wilder())}),
    "adx_14": (("high", "low"), {"|up": (lambda: _moves()[0], wilder()), "|down": (lambda: _moves()[1], wilder())}),
}


def _line() -> Column:
    return _c("|ema12") - _c("|ema26")


def _one_sided() -> Column:
    """The share of one-sided movement. Both directions are over one average range, which cancels out."""
    both = _c("|up") + _c("|down")
    return F.when(both > 0, 100 * F.abs(_c("|up") - _c("|down")) / both)


#: Means of what means made.
SECOND = {"macd_signal": (_line, spanned(9)), "adx_14": (_one_sided, wilder())}


def _value(name: str) -> Column:
    if name in SECOND:
        return _c(f"|2{name}")
    if name == "macd":
        return _line()
    if name == "rsi_14":  # 50 where nothing moved, 100 where nothing fell
        gain, loss = _c("|gain"), _c("|loss")
        return F.when(loss == 0, F.when(gain == 0, 50.0).otherwise(100.0)).otherwise(F.try_divide(100 * gain, gain + loss))
    (made,) = MEASURES[name][1]
    return _c(made)


def smoothed(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns of MEASURES, each symbol's rows in order of d; only what a measure reads has to be there."""
    kept, read = df.columns, dict.fromkeys(c for n in names for c in MEASURES[n][0])
    first = {k: (x(), m) for n in names for k, (x, m) in MEASURES[n][1].items()}
    second = {f"|2{n}": (x(), m) for n, (x, m) in SECOND.items() if n in names}
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in read}
    df = df.withColumns({f"|{c}": x for c, x in number.items()}).withColumns({f"|{c}0": F.lag(_c(f"|{c}")).over(by()) for c in read})
    df = levels(numbered(df, [m for _, m in (first | second).values()]), first)
    if second:
        df = levels(df, second)
    return df.select(*map(_c, kept), *(_value(n).alias(n) for n in names))
