"""Queries across symbols and over portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crosssection as xs, features, labels, portfolio as pf
from ..operators.windows import change
from ..sources import fixtures as fx
from .market import B, RET, W, _FEATURES, _SMOOTH, roll
from .registry import query

_BREADTH = _SMOOTH + f""", g AS (SELECT symbol, d, close FROM (SELECT DISTINCT d FROM bars) CROSS JOIN (SELECT DISTINCT symbol FROM bars) LEFT JOIN bars USING (symbol, d)),
 x AS (SELECT *, {RET} AS ret, {roll('max', 'close', 252, 20)} AS hi, {roll('min', 'close', 252, 20)} AS lo FROM g),
 y AS (SELECT d, count(close) AS universe_size, count(*) FILTER (ret > 0) AS up, count(*) FILTER (ret < 0) AS dn, count(*) FILTER (close >= hi) AS new_highs, count(*) FILTER (close <= lo) AS new_lows,
  count(*) FILTER (close > ema_20) / count(close) AS pct_above_ema20, count(*) FILTER (close > ema_50) / count(close) AS pct_above_ema50, count(*) FILTER (close > ema_200) / count(close) AS pct_above_ema200, coalesce(avg(ret), 0) AS mr FROM x LEFT JOIN smooth USING (symbol, d) GROUP BY d),
 z AS (SELECT *, product(1 + mr) OVER (ORDER BY d) AS comp FROM y)
 SELECT d, universe_size, up / nullif(dn, 0) AS advance_decline_ratio, new_highs, new_lows, pct_above_ema20, pct_above_ema50, pct_above_ema200, ln(comp / lag(comp, 20) OVER (ORDER BY d)) AS market_momentum_20, up / universe_size AS market_participation FROM z"""


@query(_BREADTH, "advance_decline_ratio pct_above_ema20 pct_above_ema50 pct_above_ema200 market_momentum_20 market_participation")
def market_breadth(spark, sf):
    """Momentum as a log: 20 steps of this data multiply far."""
    return xs.breadth(fx.bars(spark, sf)).withColumn("market_momentum_20", F.ln(1 + F.col("market_momentum_20")))


@query(fx.using("bars") + "SELECT d, up FROM (SELECT d, count(*) AS up FROM bars GROUP BY d) WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def breadth_range(spark, sf):
    """A stored daily table read between two dates."""
    return fx.bars(spark, sf).where(F.col("d").between("1996-01-01", "1996-12-31")).groupBy("d").agg(F.count("*").alias("up"))


@query(fx.using("bars") + "SELECT d, sum(volume)::bigint AS v, 'second' AS batch FROM bars WHERE d >= DATE '1998-01-01' GROUP BY d UNION ALL SELECT d, count(*)::bigint, 'first' FROM bars WHERE d < DATE '1998-01-01' GROUP BY d")
def breadth_upsert(spark, sf):
    """A second batch overwrites the dates that it has."""
    from ..operators.store import upsert

    b = fx.bars(spark, sf)
    first = b.groupBy("d").agg(F.count("*").alias("v")).withColumn("batch", F.lit("first"))
    second = b.where("d >= date '1998-01-01'").groupBy("d").agg(F.sum("volume").alias("v")).withColumn("batch", F.lit("second"))
    return upsert(first, second, "d")


_SEC = fx.using("sector_bars") + f", r AS (SELECT *, {RET} AS ret, coalesce(close > {roll('avg', 'close', 20)}, false)::int::double AS above FROM sector_bars)"


@query(_SEC + ", p AS (SELECT a.symbol, b.symbol AS peer FROM (SELECT DISTINCT symbol, sector FROM r) a JOIN (SELECT DISTINCT symbol, sector FROM r) b ON a.sector = b.sector AND a.symbol <> b.symbol) SELECT * FROM p")
def sector_peers(spark, sf):
    return xs.peers(fx.sector_bars(spark, sf)).select("symbol", "peer")


_SECTOR = (
    _SEC + f""", day AS (SELECT sector, d, sum(ret) AS s, count(ret) AS n, sum(above) AS a, count(*) AS m FROM r GROUP BY 1, 2), n AS (SELECT sector, count(DISTINCT symbol) AS k FROM r GROUP BY sector),
 e AS (SELECT symbol, sector, r.d, ret, k, CASE WHEN k > 2 THEN (s - coalesce(ret, 0)) / nullif(day.n - (ret IS NOT NULL)::int, 0) END AS sr, CASE WHEN k > 2 THEN (a - above) / nullif(m - 1, 0) END AS sb FROM r JOIN day USING (sector, d) JOIN n USING (sector)),
 i AS (SELECT *, CASE WHEN k > 2 THEN sum(ln(1 + coalesce(sr, 0))) OVER (PARTITION BY symbol ORDER BY d) END AS si, sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY symbol ORDER BY d) AS xi FROM e),
 f AS (SELECT *, list(si) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM i)
 SELECT symbol, sector, d, xi - si AS log_strength_vs_sector, ret - sr AS excess_return_vs_sector, si - lag(si, 20) {W} AS log_momentum_20, {roll('stddev_samp', 'sr', 20)} * sqrt(252) AS sector_volatility_20, CASE WHEN len(l) = 20 THEN 1 / list_avg(list_transform(l, lambda x: exp(x - si))) - 1 END AS sector_trend, sb AS sector_breadth FROM f"""
)


@query(f"SELECT * RENAME (log_strength_vs_sector AS relative_strength_vs_sector, log_momentum_20 AS sector_momentum_20) FROM ({_SECTOR})", "relative_strength_vs_sector excess_return_vs_sector sector_momentum_20 sector_volatility_20 sector_trend sector_breadth")
def sector_features(spark, sf):
    """All dates; relative strength and momentum as logs, which stay within a double however long the history is."""
    return sector_features_all_dates(spark, sf).withColumnsRenamed({"log_strength_vs_sector": "relative_strength_vs_sector", "log_momentum_20": "sector_momentum_20"})


@query(_SECTOR, "log_strength_vs_sector excess_return_vs_sector log_momentum_20 sector_volatility_20 sector_trend sector_breadth")
def sector_features_all_dates(spark, sf):
    return xs.sector_logs(fx.sector_bars(spark, sf))


@query(B + f", r AS (SELECT symbol, d, {RET} AS ret FROM bars) SELECT x.symbol AS a, y.symbol AS b, corr(x.ret, y.ret) AS corr FROM r x JOIN r y USING (d) WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2", "corr")
def correlation_matrix(spark, sf):
    return xs.correlation_matrix(fx.bars(spark, sf))


_COLS = features.BASE


@query(_SMOOTH + _FEATURES + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feats" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") WHERE abs(corr) > .6", "corr")
def feature_redundancy(spark, sf):
    return xs.feature_pairs(features.build(fx.bars(spark, sf), "v1"), _COLS, 0.6)


_LABELCORR = _SMOOTH + _FEATURES + ", lc AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, label) AS corr FROM feats" for a in _COLS) + ")"


@query(_LABELCORR + " SELECT *, abs(corr) > .95 AS leak FROM lc", "corr")
def feature_leakage(spark, sf):
    df = features.build(fx.bars(spark, sf).withColumn("label", labels.direction()), "v1")
    return xs.label_correlation(df, _COLS)


@query(_LABELCORR + " SELECT feature, corr, row_number() OVER (ORDER BY abs(corr) DESC, feature)::int AS rank FROM lc QUALIFY rank <= 5", "corr")
def feature_selection(spark, sf):
    df = features.build(fx.bars(spark, sf).withColumn("label", labels.direction()), "v1")
    return xs.top_fraction(xs.label_correlation(df, _COLS))


@query(fx.using("news") + "SELECT d, avg(length(headline) % 3 - 1) AS sentiment FROM news GROUP BY d", "sentiment")
def sentiment_by_date(spark, sf):
    return fx.news(spark, sf).groupBy("d").agg(F.avg((F.length("headline") % 3 - 1)).alias("sentiment"))


_PRICES = ", prices AS (SELECT symbol, arg_max(close, d) AS price FROM bars GROUP BY symbol)"
_LOTS = fx.using("bars", "lots") + _PRICES + ", sh AS (SELECT portfolio_id, symbol, sum(shares) AS shares FROM lots GROUP BY 1, 2), pos AS (SELECT portfolio_id, symbol, shares, price, shares * price AS value, shares * price / nullif(sum(shares * price) OVER (PARTITION BY portfolio_id), 0) AS weight FROM sh JOIN prices USING (symbol))"


def prices(spark, sf):
    return fx.bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "d").alias("price"))


def weights(spark, sf):
    return pf.positions(pf.shares_by_symbol(fx.lots(spark, sf), "portfolio_id"), prices(spark, sf), "portfolio_id")


@query(_LOTS + "SELECT portfolio_id, symbol, shares FROM sh")
def shares_by_symbol(spark, sf):
    return pf.shares_by_symbol(fx.lots(spark, sf), "portfolio_id")


@query(_LOTS + "SELECT portfolio_id, symbol, shares, weight FROM pos", "weight")
def portfolio_weights(spark, sf):
    return weights(spark, sf).select("portfolio_id", "symbol", "shares", "weight")


_SECTORS = "CASE WHEN CAST(substr(symbol, 7) AS int) % 4 = 0 THEN '' WHEN CAST(substr(symbol, 7) AS int) % 4 = 1 THEN NULL ELSE 's' || (CAST(substr(symbol, 7) AS int) % 4) END"


@query(_LOTS + f"SELECT portfolio_id, coalesce(nullif({_SECTORS}, ''), 'Unknown') AS sector, sum(weight) AS weight FROM pos GROUP BY 1, 2", "weight")
def sector_allocation(spark, sf):
    sectors = fx.bars(spark, sf).select("symbol").distinct().withColumn("sector", F.expr(_SECTORS))
    return pf.sector_allocation(weights(spark, sf), sectors, "portfolio_id")


@query(_LOTS + "SELECT portfolio_id, round_even(coalesce((1 - sum(weight * weight) FILTER (weight > 0)) * 100, 0), 1) AS score FROM pos GROUP BY 1", "score")
def diversification_score(spark, sf):
    return weights(spark, sf).groupBy("portfolio_id").agg(pf.diversification().alias("score"))


@query(_LOTS + "SELECT portfolio_id, symbol, shares, shares * price AS market_value, (price - avg_cost) / nullif(avg_cost, 0) AS gain_pct FROM lots JOIN prices USING (symbol)", "gain_pct")
def lot_gains(spark, sf):
    return pf.lot_gains(fx.lots(spark, sf), prices(spark, sf)).select("portfolio_id", "symbol", "shares", "market_value", "gain_pct")


@query(B + "SELECT symbol, d, close / first_value(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS cumulative FROM bars", "cumulative")
def cumulative_returns(spark, sf):
    return fx.bars(spark, sf).select("symbol", "d", pf.cumulative(F.col("close")).alias("cumulative"))


@query(B + "SELECT symbol, min(x) AS max_drawdown FROM (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS x FROM bars) GROUP BY symbol", "max_drawdown")
def max_drawdown(spark, sf):
    return pf.drawdown(fx.bars(spark, sf))


_RETURNS = _LOTS.rstrip() + f", rr AS (SELECT symbol, d, {RET} AS ret FROM bars)"
_PORT = _RETURNS + ", dr AS (SELECT d, sum(ret * weight) AS ret FROM rr JOIN pos USING (symbol) WHERE portfolio_id = (SELECT min(portfolio_id) FROM pos) AND ret IS NOT NULL GROUP BY d)"


def portfolio_returns(spark, sf):
    """Daily returns of the portfolio asked for, which is the report's key: that of the smallest id."""
    w = weights(spark, sf)
    return pf.daily_returns(fx.bars(spark, sf), w.join(w.agg(F.min("portfolio_id").alias("portfolio_id")), "portfolio_id", "left_semi"))


_ALL = _RETURNS + ", dr AS (SELECT portfolio_id, d, sum(ret * weight) AS ret FROM rr JOIN pos USING (symbol) WHERE ret IS NOT NULL GROUP BY portfolio_id, d)"
_BENCH = ", bm AS (SELECT d, avg(ret) AS b FROM rr WHERE ret IS NOT NULL GROUP BY d)"


@query(_PORT + " SELECT * FROM dr", "ret")
def portfolio_daily_returns(spark, sf):
    return portfolio_returns(spark, sf)


def yearly(spark, sf):
    """What all portfolios' daily returns were in each year."""
    n = fx.table(spark, sf, "orders").agg(F.approx_count_distinct("o_custkey")).first()[0]  # for the number of blocks alone
    return pf.yearly(fx.bars(spark, sf), weights(spark, sf), "portfolio_id", n)


@query(_ALL + " SELECT portfolio_id, year(d)::int AS year, count(*) AS days, avg(ret) AS mean, stddev_samp(ret) AS deviation, min(ret) AS worst, max(ret) AS best FROM dr GROUP BY 1, 2", "mean deviation worst best")
def portfolio_yearly_returns(spark, sf):
    """All portfolios: what their daily returns were in each year."""
    return yearly(spark, sf).select("portfolio_id", "year", "days", "mean", pf.deviation(F.col("n"), F.col("squares")).alias("deviation"), "worst", "best")


@query(
    _RETURNS + """, ar AS (SELECT portfolio_id, d, sum(ret * weight) AS ret FROM rr JOIN pos USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL),
 s AS (SELECT portfolio_id, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, coalesce(avg(ret) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) * sqrt(252), 0) AS sortino, stddev_samp(ret) * sqrt(252) AS volatility FROM ar GROUP BY portfolio_id)
 SELECT *, CASE WHEN volatility < .15 THEN 'Low' WHEN volatility < .3 THEN 'Medium' WHEN volatility IS NOT NULL THEN 'High' END AS risk_level FROM s""",
    "sharpe sortino volatility",
)
def portfolio_risk(spark, sf):
    """All portfolios, from what their daily returns were in each year."""
    h = pf.whole_history(yearly(spark, sf), "portfolio_id")
    n, mean, dev = F.col("n"), F.when(F.col("n") > 0, F.col("mean")), pf.deviation(F.col("n"), F.col("squares"))
    out = h.select("portfolio_id", pf.sharpe_of(n, mean, dev).alias("sharpe"), pf.sortino_of(mean, pf.deviation(F.col("low_n"), F.col("low_squares"))).alias("sortino"), (dev * pf.ROOT).alias("volatility"))
    return out.withColumn("risk_level", pf.risk_level(F.col("volatility")))


@query(
    _PORT + _BENCH + """, j AS (SELECT d, ret, b FROM dr JOIN bm USING (d))
 SELECT d, sum(CASE WHEN 1 + ret > 0 THEN ln(1 + ret) ELSE '-inf'::double END) OVER w AS portfolio, sum(CASE WHEN 1 + b > 0 THEN ln(1 + b) ELSE '-inf'::double END) OVER w AS benchmark FROM j WINDOW w AS (ORDER BY d)""",
    "portfolio benchmark",
)
def portfolio_vs_benchmark(spark, sf):
    """Logs of both curves on all shared dates."""
    w = Window.partitionBy().orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return portfolio_returns(spark, sf).join(benchmark(spark, sf), "d").select("d", F.sum(pf.growth(F.col("ret"))).over(w).alias("portfolio"), F.sum(pf.growth(F.col("b"))).over(w).alias("benchmark"))


def benchmark(spark, sf):
    """Mean return of all symbols by date."""
    return fx.bars(spark, sf).withColumn("ret", change(F.col("close"))).where("ret is not null").groupBy("d").agg(F.avg("ret").alias("b"))


@query(
    _ALL + _BENCH + """, j AS (SELECT portfolio_id, d, CASE WHEN 1 + ret > 0 THEN ln(1 + ret) ELSE '-inf'::double END AS p, CASE WHEN 1 + b > 0 THEN ln(1 + b) ELSE '-inf'::double END AS b FROM dr JOIN bm USING (d)),
 y AS (SELECT portfolio_id, year(d)::int AS year, sum(p) AS p, sum(b) AS b FROM j GROUP BY 1, 2)
 SELECT portfolio_id, year, sum(p) OVER w AS portfolio, sum(b) OVER w AS benchmark FROM y WINDOW w AS (PARTITION BY portfolio_id ORDER BY year)""",
    "portfolio benchmark",
)
def portfolios_vs_benchmark(spark, sf):
    """Logs of both curves of all portfolios at the end of each year, over all shared dates."""
    w = Window.partitionBy("portfolio_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return yearly(spark, sf).select("portfolio_id", "year", F.sum("portfolio").over(w).alias("portfolio"), F.sum("benchmark").over(w).alias("benchmark"))


_PATHS = _PORT + """, h AS (SELECT ret, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM dr), dw AS (SELECT sim, step, ('0x' || substr(md5('42:' || sim || ':' || step), 1, 12))::bigint % (SELECT any_value(n) FROM h) AS k FROM range(500) a(sim), range(1, 253) b(step)),
 pw AS (SELECT sim, step, sum(ln(1 + ret)) OVER (PARTITION BY sim ORDER BY step) AS value FROM dw JOIN h USING (k) UNION ALL SELECT sim, 0, 0 FROM range(500) a(sim))
 SELECT step::int AS step, ln(100000) + quantile_cont(value, .05) AS p5, ln(100000) + quantile_cont(value, .5) AS p50, ln(100000) + quantile_cont(value, .95) AS p95 FROM pw GROUP BY step"""


@query(_PATHS, "p5 p50 p95")
def monte_carlo(spark, sf):
    """Logs of the value percentiles of bootstrapped paths of one portfolio; percentiles are taken of logs."""
    paths = pf.monte_carlo(portfolio_returns(spark, sf))
    return pf.path_percentiles(paths.withColumn("value", F.ln("value")))


@query("SELECT (l_partkey % 20)::int AS step, quantile_cont(l_quantity, .05) AS p5, quantile_cont(l_quantity, .5) AS p50, quantile_cont(l_quantity, .95) AS p95 FROM lineitem GROUP BY 1", "p5 p50 p95")
def path_percentiles(spark, sf):
    return pf.path_percentiles(fx.table(spark, sf, "lineitem").select((F.col("l_partkey") % 20).cast("int").alias("step"), F.col("l_quantity").alias("value")))


_SIGNAL = B + f", sg AS (SELECT symbol, d, CASE WHEN {RET} > 0 THEN 1 ELSE 0 END AS signal, lead(close) {W} / close - 1 AS nr FROM bars)"


def signals(spark, sf):
    """Persistence: long after a rise."""
    return fx.bars(spark, sf).select("symbol", "d", F.coalesce((change(F.col("close")) > 0).cast("int"), F.lit(0)).alias("signal"), labels.ahead().alias("next_ret"))


_CURVES = _SIGNAL + " SELECT symbol, d, sum(ln(1 + coalesce(nr * signal, 0))) OVER w AS strategy, sum(ln(1 + coalesce(nr, 0))) OVER w AS hold FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY d)"


@query(_CURVES, "strategy hold")
def equity_curves(spark, sf):
    """Logs of both curves."""
    return pf.log_equity(signals(spark, sf)).select("symbol", "d", "strategy", "hold")


@query(_CURVES, "strategy hold")
def equity_curves_all_dates(spark, sf):
    """equity_curves under its former name."""
    return equity_curves(spark, sf)


_METRICS = _SIGNAL + """, q AS (SELECT *, nr * signal AS r, sum(ln(1 + coalesce(nr * signal, 0))) OVER w AS eq, coalesce(signal - lag(signal) OVER w, 0) <> 0 AS t FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY d)),
 q2 AS (SELECT *, exp(eq - max(eq) OVER (PARTITION BY symbol ORDER BY d)) - 1 AS dd FROM q),
 a AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, coalesce(avg(r) / nullif(stddev_samp(r) FILTER (r < 0), 0) * sqrt(252), 0) AS sortino, coalesce(sum(r) FILTER (signal = 1 AND r > 0), 0) AS g, coalesce(sum(r) FILTER (signal = 1 AND r < 0), 0) AS l, min(dd) AS max_drawdown,
  count(*) FILTER (signal = 1 AND r > 0) / nullif(count(*) FILTER (signal = 1), 0) AS win_rate, coalesce(avg(r) FILTER (signal = 1 AND r > 0), 0) AS avg_gain, coalesce(avg(r) FILTER (signal = 1 AND r < 0), 0) AS avg_loss, arg_max(eq, d) AS fin, count(*) AS n, stddev_samp(r) * sqrt(252) AS volatility, count(*) FILTER (t) / count(*) AS turnover FROM q2 GROUP BY symbol)
 SELECT symbol, sharpe, sortino, least((exp(fin * 252 / n) - 1) / abs(nullif(max_drawdown, 0)), 1e6) AS calmar, CASE WHEN l <> 0 THEN g / abs(l) WHEN g > 0 THEN 'inf'::double ELSE 0 END AS profit_factor, max_drawdown, win_rate, avg_gain, avg_loss, least(exp(fin * 252 / n) - 1, 1e6) AS annual_return, volatility, turnover FROM a"""
_ELEVEN = "sharpe sortino calmar profit_factor max_drawdown win_rate avg_gain avg_loss annual_return volatility turnover"


@query(_METRICS, _ELEVEN)
def trading_metrics(spark, sf):
    """Eleven measures per symbol over its history; yearly return and calmar are cut off at a million, for they can be astronomical here."""
    df = pf.trading_metrics(signals(spark, sf))
    return df.withColumns({c: F.least(c, F.lit(1e6)) for c in ("calmar", "annual_return")})


@query(_METRICS, _ELEVEN)
def trading_metrics_all_dates(spark, sf):
    """trading_metrics under its former name."""
    return trading_metrics(spark, sf)


@query(B + """, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 60), m AS (SELECT symbol, close, max(close) OVER w AS mx, min(close) OVER w AS mn FROM l WINDOW w AS (PARTITION BY symbol ORDER BY d))
 SELECT symbol, CASE WHEN count(*) < 5 THEN 0 ELSE min((close - mx) / mx) END AS expected_drawdown, CASE WHEN count(*) < 5 THEN 0 ELSE max((close - mn) / mn) END AS expected_upside FROM m GROUP BY symbol""", "expected_drawdown expected_upside")
def recent_swings(spark, sf):
    return pf.recent_swings(fx.bars(spark, sf))


@query(B + ", c AS (SELECT d, symbol, close, count(*) OVER (PARTITION BY d) AS n FROM bars) SELECT d, symbol, close FROM c WHERE n = (SELECT count(DISTINCT symbol) FROM bars)")
def multi_symbol_close(spark, sf):
    """Closes on the dates that all symbols share."""
    b = fx.bars(spark, sf)
    n = b.select(F.count_distinct("symbol").alias("all_n"))
    per = b.groupBy("d").agg(F.count("*").alias("all_n"))
    return b.join(per.join(F.broadcast(n), "all_n", "left_semi"), "d", "left_semi").select("d", "symbol", "close")
