"""Bands: a measure to a mood (good, neutral, worried) or a level. Bounds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(value: Column, *rules: tuple[Column, str], otherwise: str = "neutral") -> Column:
    out = F.when(value.isNull(), "unavailable")
    for when, mood in rules:
        out = out.when(when, mood)
    return out.otherwise(otherwise)


def rsi(v: Column) -> Column:
    return _bands(v, (v >= 70, "overbought"), (v <= 30, "oversold"))


def macd(m: Column, s: Column) -> Column:
    return F.when(m.isNull() | s.isNull(), "unavailable").when((m > s) & (m > 0), "strong_up").when(m > s, "turning_up").when(m < 0, "strong_down").otherwise("turning_down")


def bollinger(price: Column, upper: Column, lower: Column) -> Column:
    return F.when(price.isNull() | upper.isNull() | lower.isNull(), "unavailable").when(price >= upper, "above").when(price <= lower, "below").otherwise("inside")


def volatility(v: Column) -> Column:
    return _bands(v, (v >= 0.45, "high"), (v <= 0.20, "low"), otherwise="moderate")


def atr(v: Column, price: Column) -> Column:
    pct = v / F.nullif(price, F.lit(0.0))
    return _bands(pct, (pct >= 0.03, "worried"), (pct <= 0.015, "good"))


def adx(v: Column) -> Column:
    return _bands(v, (v >= 25, "strong"), otherwise="weak")


def vwap(price: Column, v: Column) -> Column:
    return F.when(price.isNull() | v.isNull(), "unavailable").when(price > v, "above").otherwise("below")


def sharpe(v: Column) -> Column:
    return _bands(v, (v >= 1.0, "good"), (v <= 0, "poor"), otherwise="moderate")


def drawdown(v: Column) -> Column:
    pct = F.abs(v)
    return _bands(pct, (pct >= 0.30, "deep"), (pct <= 0.10, "shallow"), otherwise="moderate")


def diversification(v: Column) -> Column:
    return _bands(v, (v >= 70, "good"), (v < 40, "concentrated"), otherwise="moderate")


def price_earnings(v: Column) -> Column:
    return _bands(v, (v <= 0, "loss"), (v > 40, "expensive"), (v < 10, "cheap"), otherwise="typical")


def sentiment(v: Column) -> Column:
    return _bands(v, (v > 0.15, "good"), (v < -0.15, "worried"))


def confidence_score(p: Column) -> Column:
    return F.abs(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) - 0.5) * 200


def confidence_level(score: Column) -> Column:
    return F.when(score >= 80, "Very High").when(score >= 60, "High").when(score >= 35, "Medium").when(score >= 15, "Low").when(score.isNotNull(), "Very Low")


def drift(value: Column, moderate: float, significant: float) -> Column:
    return F.when(value.isNull(), "Insufficient Data").when(value < moderate, "No Drift").when(value < significant, "Moderate Drift").otherwise("Significant Drift")


def rsi_badge(v: Column, simple: bool = True) -> Column:
    words = ("Hot", "Cold", "Balanced") if simple else ("Overbought", "Oversold", "Neutral")
    return F.when(v.isNull(), "n/a").when(v >= 70, words[0]).when(v <= 30, words[1]).otherwise(words[2])


def risk(v: Column) -> Column:
    return F.when(v < 0.20, "Low").when(v < 0.35, "Medium").when(v < 0.55, "High").when(v.isNotNull(), "Very High")


def escalated(level: Column, stability: Column) -> Column:
    """A prediction that moves much under noise (stability under 40) is of high risk in a calm market, too."""
    return F.when((stability < 40) & level.isin("Low", "Medium"), "High").otherwise(level)


def distance(level: Column, price: Column) -> Column:
    """How far price is from a support or resistance level, as a share of the level: NULL is unavailable."""
    return price / F.nullif(level, F.lit(0.0)) - 1


def support(price: Column, level: Column) -> Column:
    return _bands(price + level)


def resistance(price: Column, level: Column) -> Column:
    return _bands(price + level)


def portfolio_risk(level: Column) -> Column:
    """Mood of a portfolio's risk band."""
    return F.when(level == "Low", "good").when(level == "High", "worried").otherwise("neutral")


def dividend(yield_: Column) -> Column:
    return _bands(yield_, (yield_ > 0, "pays"), otherwise="none")


def fundamentals(price_earnings_: Column, yield_: Column) -> Column:
    """Mood of both together: a loss worries, all else is neutral."""
    return F.when(price_earnings_.isNull() & yield_.isNull(), "unavailable").when(price_earnings_ <= 0, "worried").otherwise("neutral")


def prediction(up: Column, accuracy: Column, session: Column) -> Column:
    """The guess and how often such guesses came true, out of ten (half to even)."""
    return F.concat(F.when(up, "up").otherwise("down"), F.lit(" in "), session, F.lit(", right "), F.bround(accuracy * 10, 0).cast("int").cast("string"), F.lit(" of 10 times"))
