"""Labels that look forward: direction, thresholds, bands of ATR or volatility, triple barriers and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import indicators as ind
from .windows import by, rolling


def direction(horizon: int = 1) -> Column:
    """1 if the close `horizon` rows on is higher, else 0; NULL where there is none."""
    ahead = F.lead("close", horizon).over(by())
    return F.when(ahead.isNotNull(), (ahead > F.col("close")).cast("double"))


def _three(move: Column, band: Column) -> Column:
    return F.when(move.isNull() | band.isNull(), None).when(move > band, 1.0).when(move < -band, -1.0).otherwise(0.0)


def ahead(horizon: int = 1) -> Column:
    return F.try_divide(F.lead("close", horizon).over(by()), F.col("close")) - 1


def threshold(horizon: int = 1, limit: float = 0.01) -> Column:
    return _three(ahead(horizon), F.lit(limit))


def by_volatility(df: DataFrame, name: str = "volatility_label", horizon: int = 1, n: int = 20, k: float = 0.25) -> DataFrame:
    """Three classes around k times the daily volatility."""
    df = df.withColumn("_ret", ind.returns())
    return df.withColumn(name, _three(ahead(horizon), rolling(F.stddev_samp, F.col("_ret"), n) * k)).drop("_ret")


def by_atr(df: DataFrame, name: str = "atr_label", horizon: int = 1, k: float = 0.25) -> DataFrame:
    """Three classes around k times ATR over close."""
    df = ind.smoothed(df.withColumn("_ahead", ahead(horizon)), "atr_14")
    return df.withColumn(name, _three(F.col("_ahead"), F.col("atr_14") * k / F.col("close"))).drop("_ahead")


def triple_barrier(df: DataFrame, horizon: int = 10, upper_k: float = 2.0, lower_k: float = 2.0) -> DataFrame:
    """tb_label, barrier_hit and days_to_hit: the first of the next rows whose high reaches the upper barrier or whose low the lower one;
    the upper one goes first on the same row. No hit: 0, vertical, at the last row there is."""
    path = F.collect_list(F.struct("high", "low")).over(by().rowsBetween(1, horizon))
    df = ind.smoothed(df.withColumn("_path", path), "atr_14")
    width = F.col("atr_14") / F.col("close")
    df = df.withColumns({"_up": F.col("close") * (1 + upper_k * width), "_down": F.col("close") * (1 - lower_k * width)})
    hits = F.filter(F.transform("_path", lambda x, i: F.struct(F.when(x["high"] >= F.col("_up"), 1.0).when(x["low"] <= F.col("_down"), -1.0).alias("side"), (i + 1).alias("day"))), lambda x: x["side"].isNotNull())
    df = df.withColumn("_hit", F.get(hits, F.lit(0)))
    live = F.col("atr_14").isNotNull() & (F.size("_path") > 0)
    return df.withColumns({
        "tb_label": F.when(live, F.coalesce("_hit.side", F.lit(0.0))),
        "barrier_hit": F.when(live, F.when(F.col("_hit.side") > 0, "upper").when(F.col("_hit.side") < 0, "lower").otherwise("vertical")),
        "days_to_hit": F.when(live, F.coalesce("_hit.day", F.size("_path"))),
    }).drop("_path", "_up", "_down", "_hit")


def meta(side: Column, outcome: Column) -> Column:
    """1 if a bet's side is the barrier's outcome, 0 if not; NULL where there was no bet or no outcome."""
    return F.when(side.isNotNull() & (outcome != 0), (side == outcome).cast("double"))


def to_binary(label: Column) -> Column:
    return F.when(label == 1, 1.0).when(label == -1, 0.0)
