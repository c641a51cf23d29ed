"""Technical indicators for all symbols at once.

Rolling ones are window expressions that share one exchange and sort by symbol. Recursive ones (exponential and
Wilder smoothing) are scans of affine maps on the same partitioning: see `recursion`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import ranker
from .recursion import smoothed  # noqa: F401
from .windows import by, YEAR, change, last, rolling


def sma(n: int = 20, c: str = "close") -> Column:
    return rolling(F.avg, F.col(c), n)


def returns(c: str = "close") -> Column:
    return change(F.col(c))


def log_returns(c: str = "close") -> Column:
    return F.ln(F.try_divide(F.col(c), F.lag(c).over(by())))


def volatility(df: DataFrame, name: str = "volatility_20", n: int = 20, annual: bool = True) -> DataFrame:
    """Rolling deviation of simple returns; leaves column `ret` too."""
    df = df.withColumn("ret", returns())
    return df.withColumn(name, rolling(F.stddev_samp, F.col("ret"), n) * (math.sqrt(YEAR) if annual else 1.0))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    middle, dev = sma(n), rolling(F.stddev_samp, F.col("close"), n)
    return {"middle": middle, "upper": middle + k * dev, "lower": middle - k * dev}


def true_range() -> Column:
    before = F.lag("close").over(by())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def vwap(n: int = 20) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(rolling(F.sum, typical * F.col("volume"), n), rolling(F.sum, F.col("volume"), n))


def support_resistance(n: int = 20) -> dict[str, Column]:
    return {"support": rolling(F.min, F.col("low"), n), "resistance": rolling(F.max, F.col("high"), n)}


def parkinson(n: int = 20) -> Column:
    term = F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * math.log(2))
    return F.sqrt(rolling(F.avg, term, n)) * math.sqrt(YEAR)


def yang_zhang(df: DataFrame, name: str = "yang_zhang_20", n: int = 20) -> DataFrame:
    """Overnight, open-to-close and range parts, weighted; below 0 counts as 0."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns({"_on": F.ln(o / F.lag("close").over(by())), "_oc": F.ln(c / o), "_rs": F.ln(h / c) * F.ln(h / o) + F.ln(l / c) * F.ln(l / o)})
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = rolling(F.var_samp, F.col("_on"), n) + k * rolling(F.var_samp, F.col("_oc"), n) + (1 - k) * rolling(F.avg, F.col("_rs"), n)
    return df.withColumn(name, F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))) * math.sqrt(YEAR)).drop("_on", "_oc", "_rs")


def percentile_rank(df: DataFrame, column: str, name: str, lookback: int = YEAR) -> DataFrame:
    """df with the percentile rank of a column among the last `lookback` rows. A long window is ranked in a grouped pass: as a
    window expression it would hold an array of the window for each row."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    out = df.groupBy("symbol").applyInPandas(ranker(column, name, lookback, min(lookback, max(5, lookback // 5))), schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def newest_rank(df: DataFrame, column: str, name: str, lookback: int = YEAR) -> DataFrame:
    """symbol, d, the column and its percentile_rank, of each symbol's newest row alone: an aggregate over the last `lookback` rows."""
    late = df.select("symbol", "d", column, F.row_number().over(by(newest=True)).alias("|n")).where(F.col("`|n`") <= lookback)
    got = late.groupBy("symbol").agg(F.max("d").alias("d"), F.max_by(column, "d").alias(column), F.collect_list(column).alias("|frame"))
    frame, x = F.col("`|frame`"), F.col(column)
    under, same = F.size(F.filter(frame, lambda v: v < x)), F.size(F.filter(frame, lambda v: v == x))
    rank = F.when(x.isNotNull() & (F.size(frame) >= min(lookback, max(5, lookback // 5))), (under + (same + 1) / 2) / F.size(frame))
    return got.select("symbol", "d", column, rank.alias(name))


def regime(pct: Column, low: float = 0.33, high: float = 0.67) -> Column:
    return F.when(pct <= low, "low").when(pct <= high, "medium").when(pct.isNotNull(), "high")


def trailing(n: int, f, c: Column) -> Column:
    """f over at most the last n rows, however few there are."""
    return f(c).over(last(n))
