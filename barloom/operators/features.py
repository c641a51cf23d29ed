"""Versioned feature sets: 9 base features, 27 and 34. One exchange by symbol serves all windows and the smoothing pass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import indicators as ind
from .windows import by, YEAR, change, rank_of_last, rolling

BASE = ["lag_return_1", "lag_return_2", "lag_return_3", "lag_return_5", "volume_zscore", "rsi_14", "macd", "macd_signal", "volatility_20"]
EXTENDED = [
    *BASE, "atr_14", "adx_14", "price_to_vwap", "bollinger_pct_b", "bollinger_bandwidth", "sma_20_dist", "ema_20_dist", "roc_10", "momentum_10", "volume_ratio_5_20", "gap_pct",
    "candle_body_pct", "upper_wick_pct", "lower_wick_pct", "dist_from_support", "dist_from_resistance", "dist_from_52w_high", "dist_from_52w_low",
]
ROLLED = [*EXTENDED, "rolling_return_mean_10", "momentum_20", "drawdown_20", "rolling_sharpe_20", "price_zscore_20", "return_autocorr_20", "volume_percentile_20"]
SETS = {"v1": BASE, "v2": EXTENDED, "v3": ROLLED}


def _over(a, b):
    return F.try_divide(a, b)


def _windows(df: DataFrame, version: str) -> DataFrame:
    _c, _h, _l, _o, _v = (F.col(x).cast("double") for x in ("close", "high", "low", "open", "volume"))
    df = df.withColumn("lag_return_1", change(_c))
    cols = {f"lag_return_{n}": change(_c, n) for n in (2, 3, 5)}
    cols["volume_zscore"] = _over(_v - rolling(F.avg, _v, 20), rolling(F.stddev_samp, _v, 20))
    cols["volatility_20"] = rolling(F.stddev_samp, F.col("lag_return_1"), 20) * math.sqrt(YEAR)
    if version in ("v2", "v3"):
        band = ind.bollinger()
        width = band["upper"] - band["lower"]
        span = F.nullif(_h - _l, F.lit(0.0))
        before = F.lag("close").over(by())
        sr = ind.support_resistance()
        cols |= {
            "price_to_vwap": _over(_c, ind.vwap()) - 1, "bollinger_pct_b": _over(_c - band["lower"], width), "bollinger_bandwidth": _over(width, _c), "sma_20_dist": _over(_c, ind.sma()) - 1,
            "roc_10": change(_c, 10), "momentum_10": _c - F.lag("close", 10).over(by()), "volume_ratio_5_20": _over(rolling(F.avg, _v, 5), rolling(F.avg, _v, 20)), "gap_pct": _over(_o - before, before),
            "candle_body_pct": F.abs(_c - _o) / span, "upper_wick_pct": (_h - F.greatest(_o, _c)) / span, "lower_wick_pct": (F.least(_o, _c) - _l) / span,
            "dist_from_support": _over(_c, sr["support"]) - 1, "dist_from_resistance": _over(_c, sr["resistance"]) - 1,
            "dist_from_52w_high": _over(_c, rolling(F.max, _h, YEAR, 60)) - 1, "dist_from_52w_low": _over(_c, rolling(F.min, _l, YEAR, 60)) - 1,
        }
    if version == "v3":
        ret = F.col("lag_return_1")
        df = df.withColumn("_lagged", F.lag("lag_return_1").over(by()))
        pairs = F.count(F.col("_lagged")).over(ind.last(20)) >= 20
        corr = F.corr("lag_return_1", "_lagged").over(ind.last(20))
        cols |= {
            "rolling_return_mean_10": rolling(F.avg, ret, 10), "momentum_20": _c - F.lag("close", 20).over(by()), "drawdown_20": _over(_c, rolling(F.max, _c, 20)) - 1,
            "rolling_sharpe_20": _over(rolling(F.avg, ret, 20), rolling(F.stddev_samp, ret, 20)) * math.sqrt(YEAR), "price_zscore_20": _over(_c - rolling(F.avg, _c, 20), rolling(F.stddev_samp, _c, 20)),
            "return_autocorr_20": F.when(pairs & ~F.isnan(corr), corr), "volume_percentile_20": rank_of_last(_v, 20, 20),
        }
    return df.withColumns(cols)


def build(bars: DataFrame, version: str = "v3", sentiment: DataFrame | None = None) -> DataFrame:
    """bars with the features of a version; with daily sentiment (symbol, d, sentiment), that too, 0 where there is none."""
    df = _windows(bars, version)
    need = ["rsi_14", "macd", "macd_signal"] + (["atr_14", "adx_14", "ema_20"] if version != "v1" else [])
    df = ind.smoothed(df, *need)
    names = SETS[version]
    if version != "v1":
        df = df.withColumn("ema_20_dist", _over(F.col("close"), F.col("ema_20")) - 1)
    if sentiment is not None:
        df = df.join(sentiment.select("symbol", "d", "sentiment"), ["symbol", "d"], "left").withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))
        names = [*names, "sentiment"]
    return df.select(*bars.columns, *names)


def dataset(bars: DataFrame, version: str = "v2", sentiment: DataFrame | None = None) -> DataFrame:
    """Features and next-day label; rows with a NULL in any of them go."""
    from .labels import direction

    out = build(bars.withColumn("label", direction()), version, sentiment)
    names = [c for c in out.columns if c not in bars.columns or c in ("symbol", "d")]
    return out.select(*dict.fromkeys([*names, "label"])).na.drop().withColumn("label", F.col("label").cast("int"))
