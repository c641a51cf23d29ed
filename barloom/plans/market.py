"""Queries over bars: indicators, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, indicators as ind, labels
from ..operators.windows import by, change
from ..sources import fixtures as fx
from .registry import query
from .smoothing_sql import smoothing

B = fx.using("bars")
BR = fx.using("bars", recursive=True)


def roll(f: str, c: str, n: int, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {w} >= {n if least is None else least} THEN {f}({c}) {w} END"


W = "OVER (PARTITION BY symbol ORDER BY d)"
RET = f"close / lag(close) {W} - 1"


@query(B + "SELECT * FROM bars")
def bars(spark, sf):
    return fx.bars(spark, sf)


@query(B + f"SELECT symbol, d, {roll('avg', 'close', 20)} AS sma_20 FROM bars", "sma_20")
def ind_sma(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", ind.sma().alias("sma_20"))


@query(B + f"SELECT symbol, d, {RET} AS ret, ln(close / lag(close) {W}) AS log_ret FROM bars", "ret log_ret")
def ind_returns(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", ind.returns().alias("ret"), ind.log_returns().alias("log_ret"))


@query(B + f", x AS (SELECT *, {RET} AS ret FROM bars) SELECT symbol, d, {roll('stddev_samp', 'ret', 20)} * sqrt(252) AS volatility_20, {roll('var_samp', 'ret', 20)} * 252 AS variance_20 FROM x", "volatility_20 variance_20")
def ind_volatility(spark, sf):
    df = ind.volatility(fx.bars(spark, sf))
    return df.select("symbol", "d", "volatility_20", (ind.rolling(F.var_samp, F.col("ret"), 20) * 252).alias("variance_20"))


_SMOOTH = BR + ", " + smoothing()


@query(_SMOOTH + "SELECT symbol, d, ema_20, ema_50, ema_200 FROM smooth", "ema_20 ema_50 ema_200")
def ind_ema(spark, sf):
    return ind.smoothed(fx.bars(spark, sf), "ema_20", "ema_50", "ema_200").select("symbol", "d", "ema_20", "ema_50", "ema_200")


@query(_SMOOTH + "SELECT symbol, d, rsi_14 FROM smooth", "rsi_14")
def ind_rsi(spark, sf):
    return ind.smoothed(fx.bars(spark, sf), "rsi_14").select("symbol", "d", "rsi_14")


@query(_SMOOTH + "SELECT symbol, d, macd, macd_signal, macd - macd_signal AS histogram FROM smooth", "macd macd_signal histogram")
def ind_macd(spark, sf):
    return ind.smoothed(fx.bars(spark, sf), "macd", "macd_signal").select("symbol", "d", "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("histogram"))


@query(_SMOOTH + "SELECT symbol, d, atr_14, adx_14 FROM smooth", "atr_14 adx_14")
def ind_atr_adx(spark, sf):
    return ind.smoothed(fx.bars(spark, sf), "atr_14", "adx_14").select("symbol", "d", "atr_14", "adx_14")


@query(B + f"SELECT symbol, d, m AS middle, m + 2 * s AS upper, m - 2 * s AS lower FROM (SELECT symbol, d, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)", "middle upper lower")
def ind_bollinger(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", *(c.alias(n) for n, c in ind.bollinger().items()))


@query(B + f"SELECT symbol, d, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM (SELECT *, lag(close) {W} AS pc FROM bars)")
def ind_true_range(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", ind.true_range().alias("true_range"))


@query(B + f", x AS (SELECT *, (high + low + close) / 3 * volume AS tv FROM bars) SELECT symbol, d, {roll('sum', 'tv', 20)} / {roll('sum', 'volume', 20)} AS vwap_20, {roll('min', 'low', 20)} AS support, {roll('max', 'high', 20)} AS resistance FROM x", "vwap_20 support resistance")
def ind_vwap_support(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", ind.vwap().alias("vwap_20"), *(c.alias(n) for n, c in ind.support_resistance().items()))


@query(B + f", x AS (SELECT *, ln(high / low) ** 2 / (4 * ln(2)) AS t FROM bars) SELECT symbol, d, sqrt({roll('avg', 't', 20)}) * sqrt(252) AS parkinson_20 FROM x", "parkinson_20")
def ind_parkinson(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", ind.parkinson().alias("parkinson_20"))


_YZ = f""", x AS (SELECT *, ln(open / lag(close) {W}) AS o_, ln(close / open) AS c_, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS r_ FROM bars),
 y AS (SELECT symbol, d, {roll('var_samp', 'o_', 20)} + 0.34 / (1.34 + 21.0 / 19) * {roll('var_samp', 'c_', 20)} + (1 - 0.34 / (1.34 + 21.0 / 19)) * {roll('avg', 'r_', 20)} AS v FROM x)
 SELECT symbol, d, CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 0)) * sqrt(252) END AS yang_zhang_20 FROM y"""


@query(B + _YZ, "yang_zhang_20")
def ind_yang_zhang(spark, sf):
    return ind.yang_zhang(fx.bars(spark, sf)).select("symbol", "d", "yang_zhang_20")


_VOLPCT = f""", x AS (SELECT *, {RET} AS ret FROM bars), v AS (SELECT symbol, d, {roll('stddev_samp', 'ret', 20)} * sqrt(252) AS vol FROM x),
 f AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (PARTITION BY symbol ORDER BY d ROWS 251 PRECEDING) AS fr FROM v),
 p AS (SELECT symbol, d, CASE WHEN vol IS NOT NULL AND len(fr) >= 50 THEN (len(list_filter(fr, lambda y: y < vol)) + (len(list_filter(fr, lambda y: y = vol)) + 1) / 2.0) / len(fr) END AS vol_pct FROM f)
 SELECT symbol, d, vol_pct, CASE WHEN vol_pct <= .33 THEN 'low' WHEN vol_pct <= .67 THEN 'medium' WHEN vol_pct IS NOT NULL THEN 'high' END AS regime FROM p"""


@query(B + _VOLPCT, "vol_pct")
def ind_volatility_regime(spark, sf):
    df = ind.percentile_rank(ind.volatility(fx.bars(spark, sf)), "volatility_20", "vol_pct")
    return df.select("symbol", "d", "vol_pct", ind.regime(F.col("vol_pct")).alias("regime"))


@query(
    B + f"""SELECT symbol, d, close, close / lag(close) {W} - 1 AS change_1, close / lag(close, 5) {W} - 1 AS change_5, close / lag(close, 21) {W} - 1 AS change_21,
  min(low) OVER y AS low_252, max(high) OVER y AS high_252, avg(volume) OVER (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING) AS volume_20
  FROM bars WINDOW y AS (PARTITION BY symbol ORDER BY d ROWS 251 PRECEDING) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1""",
    "close change_1 change_5 change_21 low_252 high_252 volume_20",
)
def latest_snapshot(spark, sf):
    """The newest row of each symbol: changes over 1, 5 and 21 rows, a year's range, mean volume."""
    df = fx.bars(spark, sf)
    newest = F.lead("d").over(by()).isNull().alias("newest")
    return df.select(
        "symbol", "d", "close", *(change(F.col("close"), n).alias(f"change_{n}") for n in (1, 5, 21)), ind.trailing(252, F.min, F.col("low")).alias("low_252"),
        ind.trailing(252, F.max, F.col("high")).alias("high_252"), ind.trailing(20, F.avg, F.col("volume")).alias("volume_20"), newest,
    ).where("newest").drop("newest")


@query(B + f"SELECT symbol, d, sma_20 FROM (SELECT symbol, d, {roll('avg', 'close', 20)} AS sma_20, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM bars) WHERE n <= 63", "sma_20")
def visible_range(spark, sf):
    """The last 63 rows, after computing on the whole history."""
    from pyspark.sql import Window

    df = fx.bars(spark, sf).select("symbol", "d", ind.sma().alias("sma_20"))
    return df.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("n <= 63").drop("n")


_LAGS = ", ".join(f"close / lag(close, {n}) {W} - 1 AS lag_return_{n}" for n in (1, 2, 3, 5))
_FEATURES = f""", base AS (SELECT *, volume::double AS v, {_LAGS}, lag(close) {W} AS pc, (high + low + close) / 3 * volume AS tv FROM bars),
 lagged AS (SELECT *, lag(lag_return_1) {W} AS lag_ret FROM base),
 ff AS (SELECT *, (v - {roll('avg', 'v', 20)}) / nullif({roll('stddev_samp', 'v', 20)}, 0) AS volume_zscore, {roll('stddev_samp', 'lag_return_1', 20)} * sqrt(252) AS volatility_20,
  close / ({roll('sum', 'tv', 20)} / {roll('sum', 'v', 20)}) - 1 AS price_to_vwap, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s, close / lag(close, 10) {W} - 1 AS roc_10, close - lag(close, 10) {W} AS momentum_10,
  {roll('avg', 'v', 5)} / nullif({roll('avg', 'v', 20)}, 0) AS volume_ratio_5_20, (open - pc) / pc AS gap_pct, abs(close - open) / nullif(high - low, 0) AS candle_body_pct, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_pct,
  (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_pct, close / {roll('min', 'low', 20)} - 1 AS dist_from_support, close / {roll('max', 'high', 20)} - 1 AS dist_from_resistance,
  close / {roll('max', 'high', 252, 60)} - 1 AS dist_from_52w_high, close / {roll('min', 'low', 252, 60)} - 1 AS dist_from_52w_low,
  {roll('avg', 'lag_return_1', 10)} AS rolling_return_mean_10, close - lag(close, 20) {W} AS momentum_20, close / {roll('max', 'close', 20)} - 1 AS drawdown_20,
  {roll('avg', 'lag_return_1', 20)} / nullif({roll('stddev_samp', 'lag_return_1', 20)}, 0) * sqrt(252) AS rolling_sharpe_20,
  CASE WHEN count(lag_ret) OVER w20 >= 20 THEN corr(lag_return_1, lag_ret) OVER w20 END AS return_autocorr_20, list(v) OVER w20 AS vf, lead(close) {W} AS nc
  FROM lagged WINDOW w20 AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)),
 feats AS (SELECT ff.*, rsi_14, macd, macd_signal, atr_14, adx_14, 4 * s AS width, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bollinger_pct_b, 4 * s / close AS bollinger_bandwidth, close / m - 1 AS sma_20_dist, close / ema_20 - 1 AS ema_20_dist,
  (close - m) / nullif(s, 0) AS price_zscore_20, CASE WHEN len(vf) >= 20 THEN (len(list_filter(vf, lambda y: y < v)) + (len(list_filter(vf, lambda y: y = v)) + 1) / 2.0) / len(vf) END AS volume_percentile_20,
  CASE WHEN nc IS NOT NULL THEN CASE WHEN nc > close THEN 1 ELSE 0 END END AS label FROM ff JOIN smooth USING (symbol, d))"""


def _register_features():
    for version, names in features.SETS.items():

        def run(spark, sf, version=version, names=names):
            return features.build(fx.bars(spark, sf), version).select("symbol", "d", *names)

        run.__name__ = f"features_{version}"
        query(_SMOOTH + _FEATURES + f" SELECT symbol, d, {', '.join(names)} FROM feats", " ".join(c for c in names if not c.startswith("momentum")))(run)


_register_features()


@query(_SMOOTH + _FEATURES + f" SELECT symbol, d, {', '.join(features.EXTENDED)}, label FROM feats WHERE label IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in features.EXTENDED), " ".join(c for c in features.EXTENDED if not c.startswith("momentum")))
def clean_dataset(spark, sf):
    return features.dataset(fx.bars(spark, sf), "v2")


_NEWS = ", scored AS (SELECT symbol, d, round((p - n) / nullif(p + n, 0), 2) AS s FROM (SELECT symbol, d, len(list_filter(w, lambda x: x IN ('the', 'and', 'to'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'de', 'in'))) AS n FROM (SELECT symbol, d, regexp_extract_all(lower(headline), '[a-z'']+') AS w FROM news)))"


@query(
    B + f"""SELECT symbol, d, CASE WHEN n1 IS NOT NULL THEN CASE WHEN n1 > close THEN 1.0 ELSE 0.0 END END AS direction_1, CASE WHEN n5 IS NOT NULL THEN CASE WHEN n5 > close THEN 1.0 ELSE 0.0 END END AS direction_5,
  CASE WHEN n1 IS NULL THEN NULL WHEN n1 / close - 1 > .01 THEN 1.0 WHEN n1 / close - 1 < -.01 THEN -1.0 ELSE 0.0 END AS threshold_label
  FROM (SELECT *, lead(close) {W} AS n1, lead(close, 5) {W} AS n5 FROM bars)""",
    "direction_1 direction_5 threshold_label",
)
def labels_fixed(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", labels.direction().alias("direction_1"), labels.direction(5).alias("direction_5"), labels.threshold().alias("threshold_label"))


def _band(move: str, band: str) -> str:
    return f"CASE WHEN {move} IS NULL OR {band} IS NULL THEN NULL WHEN {move} > {band} THEN 1.0 WHEN {move} < -({band}) THEN -1.0 ELSE 0.0 END"


@query(B + f", x AS (SELECT *, {RET} AS ret, lead(close) {W} / close - 1 AS mv FROM bars), y AS (SELECT symbol, d, mv, {roll('stddev_samp', 'ret', 20)} * .25 AS b FROM x) SELECT symbol, d, {_band('mv', 'b')} AS volatility_label FROM y", "volatility_label")
def labels_volatility(spark, sf):
    return labels.by_volatility(fx.bars(spark, sf)).select("symbol", "d", "volatility_label")


@query(_SMOOTH + f", x AS (SELECT symbol, d, close, lead(close) {W} / close - 1 AS mv FROM bars) SELECT symbol, d, {_band('mv', 'atr_14 * .25 / close')} AS atr_label FROM x JOIN smooth USING (symbol, d)", "atr_label")
def labels_atr(spark, sf):
    return labels.by_atr(fx.bars(spark, sf)).select("symbol", "d", "atr_label")


_TB = """, px AS (SELECT *, list({'h': high, 'l': low}) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path FROM bars),
 bar AS (SELECT symbol, d, path, close + 2 * atr_14 AS u, close - 2 * atr_14 AS b, atr_14, close * (1 + 2 * (atr_14 / close)) AS uu, close * (1 - 2 * (atr_14 / close)) AS bb FROM px JOIN smooth USING (symbol, d)),
 hit AS (SELECT *, list_filter(list_transform(path, lambda x, i: {'side': CASE WHEN x.h >= uu THEN 1.0 WHEN x.l <= bb THEN -1.0 END, 'day': i}), lambda x: x.side IS NOT NULL)[1] AS h FROM bar),
 tb AS (SELECT symbol, d, CASE WHEN ok THEN coalesce(h.side, 0.0)::double END AS tb_label, CASE WHEN ok THEN CASE WHEN h.side > 0 THEN 'upper' WHEN h.side < 0 THEN 'lower' ELSE 'vertical' END END AS barrier_hit,
   CASE WHEN ok THEN coalesce(h.day, len(path))::int END AS days_to_hit FROM (SELECT *, atr_14 IS NOT NULL AND coalesce(len(path), 0) > 0 AS ok FROM hit))"""


@query(_SMOOTH + _TB + " SELECT * FROM tb", "tb_label")
def labels_triple_barrier(spark, sf):
    return labels.triple_barrier(fx.bars(spark, sf)).select("symbol", "d", "tb_label", "barrier_hit", "days_to_hit")


@query(
    _SMOOTH + _TB + f""" SELECT symbol, d, CASE WHEN side IS NOT NULL AND tb_label <> 0 THEN CASE WHEN side = tb_label THEN 1.0 ELSE 0.0 END END AS meta_label, CASE tb_label WHEN 1 THEN 1.0 WHEN -1 THEN 0.0 END AS binary_label
 FROM tb JOIN (SELECT symbol, d, CASE WHEN lead(close) {W} IS NOT NULL THEN CASE WHEN lead(close) {W} > close THEN 1.0 ELSE -1.0 END END AS side FROM bars) USING (symbol, d)""",
    "meta_label binary_label",
)
def labels_meta(spark, sf):
    df = labels.triple_barrier(fx.bars(spark, sf).withColumn("side", labels.direction() * 2 - 1))
    return df.select("symbol", "d", labels.meta(F.col("side"), F.col("tb_label")).alias("meta_label"), labels.to_binary(F.col("tb_label")).alias("binary_label"))


@query(B + f", x AS (SELECT CASE WHEN lead(close) {W} IS NOT NULL THEN CASE WHEN lead(close) {W} > close THEN 1.0 ELSE 0.0 END END AS label FROM bars) SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM x WHERE label IS NOT NULL GROUP BY label", "label share")
def class_balance(spark, sf):
    from pyspark.sql import Window

    df = fx.bars(spark, sf).select(labels.direction().alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return df.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
