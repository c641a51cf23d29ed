"""Queries of prediction records, calibration, drift, splits, gates and model training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from ..operators import calendar as cal, evaluation as ev, features, indicators as ind, labels, models as ml, portfolio as pf, quality, store
from ..operators.windows import by, change, rolling
from ..sources import fixtures as fx, tables
from .market import B, RET, W, _FEATURES, _SMOOTH, _VOLPCT, roll
from .registry import query

_PREDS = B + f""", z AS (SELECT symbol, d, {RET} AS lag_return_1, (close - {roll('avg', 'close', 20)}) / {roll('stddev_samp', 'close', 20)} AS z, CASE WHEN lead(close) {W} > close THEN 1 WHEN lead(close) {W} IS NOT NULL THEN 0 END AS actual, row_number() {W} AS r FROM bars),
 preds AS (SELECT symbol, d, lag_return_1, round(1 / (1 + exp(-z)), 6) AS probability, CASE WHEN round(1 / (1 + exp(-z)), 6) >= .5 THEN 1 ELSE 0 END AS predicted, actual, 'm' || (r % 2) AS model_version FROM z WHERE z IS NOT NULL AND actual IS NOT NULL),
 conf AS (SELECT *, abs(probability - .5) * 200 AS score FROM preds), lev AS (SELECT *, CASE WHEN score >= 80 THEN 'Very High' WHEN score >= 60 THEN 'High' WHEN score >= 35 THEN 'Medium' WHEN score >= 15 THEN 'Low' ELSE 'Very Low' END AS confidence_level FROM conf)"""


def preds(spark, sf) -> DataFrame:
    c = F.col("close")
    z = (c - rolling(F.avg, c, 20)) / rolling(F.stddev_samp, c, 20)
    df = fx.bars(spark, sf).select("symbol", "d", change(c).alias("lag_return_1"), z.alias("z"), labels.direction().cast("int").alias("actual"), F.row_number().over(by()).alias("r"))
    df = df.where("z is not null and actual is not null").withColumn("probability", F.round(1 / (1 + F.exp(-F.col("z"))), 6))
    return df.select("symbol", "d", "lag_return_1", "probability", (F.col("probability") >= 0.5).cast("int").alias("predicted"), "actual", F.concat(F.lit("m"), (F.col("r") % 2).cast("string")).alias("model_version"))


_PERF = "count(*) AS n, avg((actual = predicted)::int) AS accuracy, coalesce(count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (predicted = 1), 0), 0) AS precision, coalesce(count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (actual = 1), 0), 0) AS recall, coalesce(2 * count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (predicted = 1) + count(*) FILTER (actual = 1), 0), 0) AS f1"
_P5 = "accuracy precision recall f1"


@query(_PREDS + f" SELECT {_PERF} FROM preds", _P5)
def performance(spark, sf):
    return ev.performance(preds(spark, sf))


@query(_PREDS + f" SELECT confidence_level, {_PERF} FROM lev GROUP BY 1", _P5)
def performance_by_confidence(spark, sf):
    return ev.performance(ev.confidence(preds(spark, sf)), "confidence_level")


@query(_PREDS + ", v AS (" + _VOLPCT.replace(", x AS", "WITH x AS", 1).lstrip() + f") SELECT regime, {_PERF} FROM preds JOIN v USING (symbol, d) WHERE regime IS NOT NULL GROUP BY 1", _P5)
def performance_by_regime(spark, sf):
    v = ind.percentile_rank(ind.volatility(fx.bars(spark, sf)), "volatility_20", "p").select("symbol", "d", ind.regime(F.col("p")).alias("regime"))
    return ev.performance(preds(spark, sf).join(v, ["symbol", "d"]), "regime")


@query(_PREDS + f", nv AS (SELECT actual, CASE WHEN lag_return_1 > 0 THEN 1 ELSE 0 END AS predicted FROM preds) SELECT {_PERF} FROM nv", _P5)
def naive_baseline(spark, sf):
    return ev.performance(ml.naive(preds(spark, sf).withColumn("label", F.col("actual"))))


@query(_PREDS + " SELECT a.v AS actual, p.v AS predicted, (SELECT count(*) FROM preds WHERE actual = a.v AND predicted = p.v) AS n FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) p(v)")
def confusion_matrix(spark, sf):
    return ev.confusion(preds(spark, sf))


_CLS = """, k AS (SELECT count(*) FILTER (actual = 1 AND predicted = 1)::double AS tp, count(*) FILTER (actual = 0 AND predicted = 1)::double AS fp, count(*) FILTER (actual = 1 AND predicted = 0)::double AS fn, count(*) FILTER (actual = 0 AND predicted = 0)::double AS tn,
  avg(-(actual * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, probability))) + (1 - actual) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, probability))))) AS log_loss, avg((probability - actual) ** 2) AS brier FROM preds),
 rk AS (SELECT actual, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r FROM preds),
 auc AS (SELECT (sum(r) FILTER (actual = 1) - count(*) FILTER (actual = 1) * (count(*) FILTER (actual = 1) + 1) / 2.0) / (count(*) FILTER (actual = 1) * count(*) FILTER (actual = 0)) AS roc_auc FROM rk),
 st AS (SELECT probability, sum(actual) AS pos, count(*) AS n FROM preds GROUP BY 1), cu AS (SELECT pos, sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(n) OVER (ORDER BY probability DESC) AS al FROM st), ap AS (SELECT sum(pos * tp / al) / sum(pos) AS pr_auc FROM cu)
 SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, log_loss, brier, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, roc_auc, pr_auc FROM k, auc, ap"""


@query(_PREDS + _CLS, "accuracy precision recall f1 log_loss brier mcc balanced_accuracy roc_auc pr_auc")
def classification_metrics(spark, sf):
    return ev.classification(preds(spark, sf))


_BIN = " + ".join(f"(probability >= {i * 0.1!r})::int" for i in range(1, 10))
_CAL = _PREDS + f", bins AS (SELECT {_BIN} AS bin, count(*) AS n, avg(probability) AS mean_p, avg(actual) AS rate FROM preds GROUP BY 1)"


@query(_CAL + " SELECT * FROM bins", "mean_p rate")
def reliability_curve(spark, sf):
    return ev.calibration_bins(preds(spark, sf))


@query(_CAL + " SELECT sum(abs(mean_p - rate) * n) / sum(n) AS ece, max(abs(mean_p - rate)) AS mce FROM bins", "ece mce")
def calibration_error(spark, sf):
    return ev.calibration_error(preds(spark, sf))


@query(_PREDS + " SELECT symbol, d, 1 / (1 + exp(-ln(q / (1 - q)) / 1.7)) AS p FROM (SELECT *, greatest(1e-12, least(1 - 1e-12, probability)) AS q FROM preds)", "p")
def temperature(spark, sf):
    return preds(spark, sf).select("symbol", "d", ev.apply_temperature(F.col("probability"), 1.7).alias("p"))


@query(_PREDS + " SELECT symbol, d, score AS confidence_score, confidence_level, CASE WHEN probability >= .5 THEN 'UP' ELSE 'DOWN' END AS prediction_class FROM lev", "confidence_score")
def confidence(spark, sf):
    return ev.confidence(preds(spark, sf)).select("symbol", "d", "confidence_score", "confidence_level", "prediction_class")


_PSI = _PREDS + """, tr AS (SELECT symbol, probability AS x FROM preds WHERE d < DATE '1999-01-01'), lv AS (SELECT symbol, probability AS x FROM preds WHERE d >= DATE '1999-01-01'),
 ed AS (SELECT symbol, list_distinct(list_transform(range(11), lambda i: NULL::double)) AS dummy, quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS e0 FROM tr GROUP BY symbol), e AS (SELECT symbol, list_sort(list_distinct(e0)) AS e FROM ed),
 g AS (SELECT symbol, unnest(range(1, len(e))) AS bin FROM e), ta AS (SELECT symbol, least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) AS bin, count(*) AS a FROM tr JOIN e USING (symbol) WHERE x >= e[1] AND x <= e[-1] GROUP BY ALL), tb AS (SELECT symbol, least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) AS bin, count(*) AS b FROM lv JOIN e USING (symbol) WHERE x >= e[1] AND x <= e[-1] GROUP BY ALL),
 s AS (SELECT symbol, greatest(coalesce(a, 0) / sum(coalesce(a, 0)) OVER (PARTITION BY symbol), 1e-6) AS pa, greatest(coalesce(b, 0) / sum(coalesce(b, 0)) OVER (PARTITION BY symbol), 1e-6) AS pb FROM g LEFT JOIN ta USING (symbol, bin) LEFT JOIN tb USING (symbol, bin)), p AS (SELECT symbol, sum((pb - pa) * ln(pb / pa)) AS psi FROM s GROUP BY symbol)
 SELECT symbol, psi, CASE WHEN psi < .1 THEN 'No Drift' WHEN psi < .25 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS status FROM p"""


@query(_PSI, "psi")
def population_stability(spark, sf):
    p = preds(spark, sf)
    cut = F.lit("1999-01-01").cast("date")
    return ev.psi(p.where(F.col("d") < cut), p.where(F.col("d") >= cut), "probability", "symbol")


_FDRIFT = _SMOOTH + _FEATURES + ", u AS (" + " UNION ALL ".join(f"SELECT symbol, d, '{c}' AS feature, {c} AS x, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM feats" for c in features.BASE) + """), z AS (SELECT * FROM u WHERE x IS NOT NULL),
 ed AS (SELECT symbol, feature, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e, count(*) AS nt FROM z WHERE n > 60 GROUP BY ALL),
 bn AS (SELECT z.symbol, z.feature, n > 60 AS tr, least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) AS bin, count(*) AS c FROM z JOIN ed USING (symbol, feature) WHERE x BETWEEN e[1] AND e[-1] GROUP BY ALL),
 gr AS (SELECT symbol, feature, nt, len(e) AS m, unnest(range(1, greatest(len(e), 2))) AS bin FROM ed), lv AS (SELECT symbol, feature, count(*) AS nl FROM z WHERE n <= 60 GROUP BY ALL),
 cn AS (SELECT g.*, coalesce(a.c, 0) AS a, coalesce(b.c, 0) AS b FROM gr g LEFT JOIN bn a ON a.tr AND a.symbol = g.symbol AND a.feature = g.feature AND a.bin = g.bin LEFT JOIN bn b ON NOT b.tr AND b.symbol = g.symbol AND b.feature = g.feature AND b.bin = g.bin),
 sh AS (SELECT *, greatest(a / greatest(sum(a) OVER w, 1), 1e-6) AS pa, greatest(b / greatest(sum(b) OVER w, 1), 1e-6) AS pb FROM cn WINDOW w AS (PARTITION BY symbol, feature)),
 ps AS (SELECT symbol, feature, any_value(nt) AS nt, any_value(m) AS m, sum((pb - pa) * ln(pb / pa)) AS v FROM sh GROUP BY ALL), fd AS (SELECT symbol, feature, CASE WHEN nt < 10 OR coalesce(nl, 0) = 0 THEN NULL WHEN m < 3 THEN 0 ELSE v END AS psi FROM ps LEFT JOIN lv USING (symbol, feature))
 SELECT symbol, feature, psi, CASE WHEN psi IS NULL THEN 'Insufficient Data' WHEN psi < .1 THEN 'No Drift' WHEN psi < .25 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS status, row_number() OVER (PARTITION BY symbol ORDER BY psi DESC NULLS LAST, feature)::int AS rank FROM fd QUALIFY rank <= 5"""


@query(_FDRIFT, "psi")
def feature_drift(spark, sf):
    """PSI of the last 60 rows of each symbol against its earlier ones, the five largest features of each."""
    f = features.build(fx.bars(spark, sf), "v1")
    long = f.select("symbol", "d", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))).alias("n"), *features.BASE).unpivot(["symbol", "d", "n"], features.BASE, "feature", "x").where("x is not null")
    out = ev.psi(long.where("n > 60"), long.where("n <= 60"), "x", "symbol", "feature")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("psi"), "feature"))).where("rank <= 5")


@query(_PREDS + ", h AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS r, count(*) OVER (PARTITION BY symbol) AS n FROM preds), x AS (SELECT symbol, any_value(n) AS n, abs(avg(probability) FILTER (r > n // 2) - avg(probability) FILTER (r <= n // 2)) AS drift FROM h GROUP BY symbol) SELECT symbol, drift, CASE WHEN drift < .1 THEN 'No Drift' WHEN drift < .25 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS status FROM x", "drift")
def prediction_drift(spark, sf):
    return ev.prediction_drift(preds(spark, sf), "symbol")


@query(_PREDS + ", x AS (SELECT symbol, .6 - avg((actual = predicted)::int) AS drop FROM preds GROUP BY symbol) SELECT symbol, drop, CASE WHEN drop < .07 THEN 'No Drift' WHEN drop < .15 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS status FROM x", "drop")
def concept_drift(spark, sf):
    return ev.concept_drift(preds(spark, sf), 0.6, "symbol")


@query("SELECT p_brand AS symbol, ['Insufficient Data', 'No Drift', 'Moderate Drift', 'Significant Drift'][max(p_size % 4) + 1] AS status FROM part GROUP BY 1")
def drift_rollup(spark, sf):
    names = F.array(*(F.lit(x) for x in ("Insufficient Data", "No Drift", "Moderate Drift", "Significant Drift")))
    return ev.worst(fx.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.get(names, F.col("p_size") % 4).alias("status")), "symbol")


@query("WITH s AS (SELECT event_type AS feature, value, ts, lag(value) OVER w AS previous, lead(value) OVER w IS NULL AS newest FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT feature, value, previous, abs(value - previous) / abs(previous) AS change, abs(value - previous) / abs(previous) > .5 AS drifted FROM s WHERE newest", "change")
def importance_drift(spark, sf):
    s = fx.table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value", F.struct("ts", "event_id").alias("computed_at"))
    return ev.importance_drift(s)


_SPLIT = B + ", dd AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars))"


@query(_SPLIT + ", s AS (SELECT d, CASE WHEN k < floor(n * .7) THEN 'train' WHEN k < floor(n * .7) + floor(n * .15) THEN 'val' ELSE 'test' END AS part FROM dd) SELECT part, min(d) AS a, max(d) AS z, count(*) AS n FROM bars JOIN s USING (d) GROUP BY part")
def chronological_split(spark, sf):
    return ev.chronological_split(fx.bars(spark, sf)).groupBy("part").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("n"))


_FOLDS = _SPLIT + ", f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold), x AS (SELECT fold, d, k < fold * (n // 6) AS tr, k >= fold * (n // 6) AND k < CASE WHEN fold = 5 THEN n ELSE (fold + 1) * (n // 6) END AS va FROM dd, f), o AS (SELECT fold, min(d) FILTER (tr) AS train_start, max(d) FILTER (tr) AS train_end, min(d) FILTER (va) AS val_start, max(d) FILTER (va) AS val_end, count(*) FILTER (va) AS val_dates FROM x GROUP BY fold)"


@query(_FOLDS + " SELECT * FROM o")
def cv_folds(spark, sf):
    return ev.expanding_folds(fx.bars(spark, sf))


@query(_FOLDS + " SELECT fold, val_start > train_end AS ok, (val_start - train_end)::int AS gap_days FROM o")
def leakage_report(spark, sf):
    return ev.leakage(ev.expanding_folds(fx.bars(spark, sf)))


@query(B + ", c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) SELECT symbol, i AS fold, i * 21 AS train_start, i * 21 + 252 AS train_end, i * 21 + 252 AS test_start, i * 21 + 273 AS test_end FROM (SELECT symbol, unnest(range(greatest((n - 252) // 21, 0))) AS i FROM c)")
def rolling_folds(spark, sf):
    n = fx.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", F.posexplode(ev.rolling_folds(F.col("n"), 252, 21)).alias("fold", "f")).select("symbol", F.col("fold").cast("long").alias("fold"), *(F.col(f"f.{c}").cast("long").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")))


@query(B + ", c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) SELECT symbol, i AS fold, n - (5 - i) * (n // 6) - 2 AS train_end, n - (5 - i) * (n // 6) AS test_start, n - (4 - i) * (n // 6) AS test_end FROM c, (SELECT unnest(range(5)) AS i)")
def time_series_split(spark, sf):
    n = fx.bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", F.posexplode(ev.end_aligned_folds(F.col("n"), 5, 2)).alias("fold", "f")).select("symbol", F.col("fold").cast("long").alias("fold"), *(F.col(f"f.{c}").cast("long").alias(c) for c in ("train_end", "test_start", "test_end")))


_RISK = _SMOOTH + ", v AS (" + _VOLPCT.replace(", x AS", "WITH x AS", 1).lstrip() + f"), lastd AS (SELECT symbol, max(d) AS d FROM bars GROUP BY symbol), rr AS (SELECT *, {RET} AS ret FROM bars), vol AS (SELECT symbol, d, {roll('stddev_samp', 'ret', 20)} * sqrt(252) AS vol FROM rr)"


@query(
    _RISK + """, k AS (SELECT symbol, coalesce(vol, 0) AS vol, regime, adx_14, greatest(0, least(100, coalesce(vol, 0) / .6 * 100)) AS vs FROM lastd JOIN vol USING (symbol, d) JOIN v USING (symbol, d) JOIN smooth USING (symbol, d))
 SELECT symbol, vol AS volatility, vs AS volatility_score, .6 * vs + 20 AS risk_score, CASE WHEN vol < .2 THEN 'Low' WHEN vol < .35 THEN 'Medium' WHEN vol < .55 THEN 'High' ELSE 'Very High' END AS risk_level, (CASE WHEN adx_14 >= 25 THEN 'trending' ELSE 'ranging' END) || ', ' || regime || ' volatility' AS market_regime FROM k""",
    "volatility volatility_score risk_score",
)
def risk_assessment(spark, sf):
    """Newest row of each symbol; without a model, stability counts 50."""
    bars = fx.bars(spark, sf)
    df = ind.newest_rank(ind.volatility(bars), "volatility_20", "vol_pct").withColumn("regime", ind.regime(F.col("vol_pct")))
    adx = ind.smoothed(bars.withColumn("newest", F.lead("d").over(by()).isNull()), "adx_14").where("newest").select("symbol", "adx_14")
    df = df.join(adx, "symbol")
    v = F.coalesce("volatility_20", F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), v / 0.6 * 100))
    return df.select("symbol", v.alias("volatility"), score.alias("volatility_score"), (0.6 * score + 0.4 * 50).alias("risk_score"), bands.risk(v).alias("risk_level"), F.concat(F.when(F.col("adx_14") >= 25, "trending").otherwise("ranging"), F.lit(", "), F.col("regime"), F.lit(" volatility")).alias("market_regime"))


@query(_PREDS + " SELECT symbol, d, model_version FROM preds WHERE model_version = 'm1'")
def record_predictions(spark, sf):
    """Appended unless symbol, date and version are recorded."""
    p = preds(spark, sf).select("symbol", "d", "model_version")
    return store.insert_ignore(p.where("model_version = 'm0'"), p.unionByName(p), "symbol", "d", "model_version")


@query(B + ", t AS (SELECT d, lag(d) OVER (ORDER BY d) AS pd FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY))::date AS d) WHERE isodow(d) < 6) SELECT a.symbol, a.d, (a.close > b.close)::int AS actual FROM bars a JOIN t USING (d) JOIN bars b ON b.symbol = a.symbol AND b.d = t.pd")
def resolve_outcomes(spark, sf):
    """Close against that of the calendar's previous trading day; both must exist."""
    b = fx.bars(spark, sf)
    days = cal.with_previous(cal.dates(spark, "1995-01-01", "2002-01-01").where(cal.is_trading_day(F.col("d"))))
    before = b.select("symbol", F.col("d").alias("prev_d"), F.col("close").alias("prev_close"))
    return b.join(days, "d").join(before, ["symbol", "prev_d"]).select("symbol", "d", (F.col("close") > F.col("prev_close")).cast("int").alias("actual"))


@query(_PREDS + " SELECT symbol, d, CASE WHEN probability >= .5 THEN 'Leans Up' ELSE 'Leans Down' END AS stance, CASE WHEN probability >= .5 THEN -.1 ELSE .2 END::double AS reference_level, 'High risk; ' || CASE WHEN symbol < 'Brand#3' THEN 'live drift; ' ELSE '' END || 'old data' || CASE WHEN confidence_level IN ('Low', 'Very Low') THEN '; near a coin flip' ELSE '' END AS key_risks FROM lev")
def recommendations(spark, sf):
    p = ev.confidence(preds(spark, sf)).withColumns({"drift_status": F.when(F.col("symbol") < "Brand#3", "Significant Drift"), "freshness": F.lit("Stale"), "risk_level": F.lit("High"), "expected_drawdown": F.lit(-0.1), "expected_upside": F.lit(0.2)})
    return ml.recommendation(p).select("symbol", "d", "stance", "reference_level", "key_risks")


_GATE = "SELECT p_partkey, (p_partkey % 17) / 20.0 + .1 AS train_auc, (p_partkey % 13) / 20.0 + .1031 AS val_auc, (p_partkey % 7) / 10.0 AS train_accuracy, (p_partkey % 5) / 10.0 AS val_accuracy, .37 AS baseline, .53 AS fold_mean, (p_partkey % 11) / 100.0 AS fold_std FROM part"


@query(f"WITH m AS ({_GATE}), f AS (SELECT p_partkey, abs(train_auc - val_auc) / train_auc * 100 > 20 AS overfit, (train_accuracy - baseline) / baseline * 100 < 5 AND (val_accuracy - baseline) / baseline * 100 < 5 AS underfit, fold_std / fold_mean * 100 > 15 AS instability FROM m) SELECT *, NOT (overfit OR underfit OR instability) AS passed FROM f")
def generalization_gate(spark, sf):
    k = F.col("p_partkey")
    m = fx.table(spark, sf, "part").select("p_partkey", ((k % 17) / F.lit(20.0) + 0.1).alias("train_auc"), ((k % 13) / F.lit(20.0) + 0.1031).alias("val_auc"), ((k % 7) / F.lit(10.0)).alias("train_accuracy"), ((k % 5) / F.lit(10.0)).alias("val_accuracy"), F.lit(0.37).alias("baseline"), F.lit(0.53).alias("fold_mean"), ((k % 11) / F.lit(100.0)).alias("fold_std"))
    return ev.generalization_gate(m).select("p_partkey", "overfit", "underfit", "instability", "passed")


@query("WITH m AS (SELECT p_partkey, .5::double AS b, .5::double + (p_partkey % 9 - 4) / 500.0::double AS a, 1.0 - (p_partkey % 4) * .006 AS s FROM part) SELECT p_partkey, (a - b) / b * 100 AS relative_improvement_pct, (a - b) / b * 100 > .5 AND NOT (s < .99) AND p_partkey % 10 <> 0 AS keep FROM m", "relative_improvement_pct")
def keep_decision(spark, sf):
    k = F.col("p_partkey")
    m = fx.table(spark, sf, "part").select("p_partkey", F.lit(0.5).alias("before"), (0.5 + (k % 9 - 4) / F.lit(500.0)).alias("after"), F.array(F.lit(1.0), F.lit(0.0)).alias("second_before"), F.array(1.0 - (k % 4) * 0.006, F.lit(-1.0)).alias("second_after"), (k % 10 == 0).alias("new_failures"), F.lit(False).alias("new_flags"))
    return ev.keep_decision(m).select("p_partkey", "relative_improvement_pct", "keep")


@query(
    """WITH m AS (SELECT p_brand AS challenger, p_size % 5 AS fold, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), c AS (SELECT p_size % 5 AS fold, avg(p_retailprice) AS v FROM part GROUP BY 1),
 r AS (SELECT challenger, m.v - c.v AS x, row_number() OVER (PARTITION BY challenger ORDER BY abs(m.v - c.v)) AS k FROM m JOIN c USING (fold)), w AS (SELECT challenger, count(*) AS n, sum(x) AS total, coalesce(sum(k) FILTER (x > 0), 0) AS plus FROM r GROUP BY 1),
 s AS (SELECT v, list_sum([((v >> i) & 1) * (i + 1) FOR i IN range(5)]) AS t FROM range(32) u(v)), p AS (SELECT *, (SELECT count(*) FROM s WHERE t >= plus) / 32.0 AS p_value FROM w)
 SELECT challenger, p_value, p_value < .05 AND total > 0 AND split_part(challenger, '#', 2)::int / 130.0 <= .15 AND split_part(challenger, '#', 2)::int * 9.0 <= 200 AS promote FROM p WHERE n = 5""",
    "p_value",
)
def promotion(spark, sf):
    """Each brand's model against the common champion over five paired folds: the exact test's smallest p is 1/32."""
    part = fx.table(spark, sf, "part").withColumn("fold", F.col("p_size") % 5)
    by_fold = F.transform(F.array_sort(F.collect_list(F.struct("fold", "v"))), lambda x: x["v"])
    own = part.groupBy(F.col("p_brand").alias("challenger"), "fold").agg(F.avg("p_retailprice").alias("v")).groupBy("challenger").agg(by_fold.alias("fold_metrics")).where(F.size("fold_metrics") == 5)
    champion = part.groupBy("fold").agg(F.avg("p_retailprice").alias("v")).agg(by_fold.alias("champion_metrics"))
    number = F.substring_index("challenger", "#", -1).cast("int")
    models = own.join(F.broadcast(champion)).withColumns({"ece": number / F.lit(130.0), "latency_ms": number * 9.0})
    return ev.promotions(models).select("challenger", "p_value", "promote")


@query(_PREDS + ", e AS (SELECT symbol, d, avg(p) AS probability FROM (SELECT symbol, d, probability AS p FROM preds UNION ALL SELECT symbol, d, CASE WHEN lag_return_1 > 0 THEN .75 ELSE .25 END FROM preds) GROUP BY 1, 2) SELECT symbol, d, probability, (probability >= .5)::int AS predicted FROM e")
def soft_vote(spark, sf):
    p = preds(spark, sf)
    second = p.select("symbol", "d", F.when(F.col("lag_return_1") > 0, 0.75).otherwise(0.25).alias("probability"))
    return ml.ensemble(p.select("symbol", "d", "probability").unionByName(second), "symbol", "d")


@query(_PREDS + " SELECT symbol, d, probability FROM preds WHERE symbol = 'Brand#11' ORDER BY d DESC, model_version DESC LIMIT 60")
def prediction_timeline(spark, sf):
    return preds(spark, sf).where("symbol = 'Brand#11'").orderBy(F.desc("d"), F.desc("model_version")).limit(60).select("symbol", "d", "probability")


@query(B + f", s AS (SELECT symbol, d, close / lag(close) {W} - 1 AS c, volume, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM bars) SELECT (SELECT arg_max(symbol, c) FROM s WHERE n = 1) AS best, (SELECT arg_min(symbol, c) FROM s WHERE n = 1) AS worst, (SELECT string_agg(symbol, ',' ORDER BY volume DESC, symbol) FROM (SELECT * FROM s WHERE n = 1 ORDER BY volume DESC, symbol LIMIT 10)) AS leaders")
def movers(spark, sf):
    """Best and worst change, and the ten largest volumes, of the newest rows."""
    df = fx.bars(spark, sf).select("symbol", "d", "volume", change(F.col("close")).alias("c"), F.lead("d").over(by()).isNull().alias("newest")).where("newest")
    top = df.orderBy(F.desc("volume"), "symbol").limit(10)
    lead = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("volume")).alias("v"), "symbol"))), lambda x: x["symbol"]), ",").alias("leaders"))
    return df.agg(F.max_by("symbol", "c").alias("best"), F.min_by("symbol", "c").alias("worst")).join(lead)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2")
def latest_and_previous(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return fx.table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")
def set_intersect(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).intersect(fx.table(spark, sf, "region").select("r_regionkey"))


@query("SELECT l_suppkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity < 40")
def set_except(spark, sf):
    line = fx.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    return line.drop("l_quantity").exceptAll(line.where("l_quantity < 40").drop("l_quantity"))


@query(
    "SELECT 'bars' AS part, count(*) > 0 AS ok FROM lineitem UNION ALL SELECT 'events', count(*) > 0 FROM events UNION ALL SELECT 'model', count(*) FILTER (p_partkey % 3 = 0) > 0 FROM part UNION ALL SELECT 'features', count(*) > 0 AND count(*) = count(l_shipdate) FROM lineitem"
)
def system_health(spark, sf):
    """A row for each part: stored bars, calls and ticks, an active model in the registry, bars that features can be made of."""
    line = fx.table(spark, sf, "lineitem").agg((F.count("*") > 0).alias("bars"), ((F.count("*") > 0) & (F.count("*") == F.count("l_shipdate"))).alias("features"))
    events = fx.table(spark, sf, "events").agg((F.count("*") > 0).alias("ok")).selectExpr("'events' as part", "ok")
    model = fx.table(spark, sf, "part").agg((F.count_if(F.col("p_partkey") % 3 == 0) > 0).alias("ok")).selectExpr("'model' as part", "ok")
    return line.unpivot([], ["bars", "features"], "part", "ok").unionByName(events).unionByName(model)


# ---- model training: tested for invariants; there is no SQL for it


def _written(spark, df, name):
    """df, written down once: fits read it many times."""
    path = tables.shared(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _rows(spark, sf):
    """The v1 dataset of all symbols."""
    return _written(spark, features.dataset(fx.bars(spark, sf), "v1"), "rows")


@query()
def model_cv(spark, sf):
    """Metrics of each expanding fold of small models of each tree family."""
    rows, out = _rows(spark, sf), []
    spans = ml.folds(rows, 3)
    for family, params in {"random_forest": {"trees": 10, "depth": 3}, "gradient_boosting": {"trees": 5, "depth": 3}, "oblivious_boosting": {"trees": 4, "depth": 3, "step": 0.3}, "leafwise_boosting": {"trees": 3, "depth": 2, "step": 0.3}}.items():
        out += [(family, g["fold"], g.get("accuracy"), g.get("roc_auc"), g.get("log_loss")) for g in ml.fold_scores(family, params, rows, features.BASE, spans)]
    return spark.createDataFrame(out, "family string, fold int, accuracy double, roc_auc double, log_loss double")


@query()
def model_walk_forward(spark, sf):
    """Predictions of all walk-forward windows, by date over all symbols."""
    return ml.walk_forward(_rows(spark, sf), features.BASE, 252, 42, params={"trees": 10, "depth": 3}).select("symbol", "d", "fold", "probability", "predicted", "actual")


@query()
def model_calibration(spark, sf):
    """Brier score and calibration errors of four methods, fitted on one part of the predictions and measured on the other."""
    p = _written(spark, preds(spark, sf), "predictions")
    return ml.calibrate(p.where("d < date '1998-01-01'"), p.where("d >= date '1998-01-01'"))


@query()
def mutual_information(spark, sf):
    return ml.mutual_information(_rows(spark, sf), features.BASE)


@query()
def importance_stability(spark, sf):
    return ml.importance_stability(_rows(spark, sf), features.BASE, 2)


@query()
def explanation(spark, sf):
    """What each feature adds to the prediction of the newest row of each symbol, largest first."""
    rows = _rows(spark, sf)
    model = ml.fit("random_forest", {"trees": 10, "depth": 3}, rows, features.BASE)
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("n = 1").drop("n")
    return ml.explain(model, newest, features.BASE, None)


@query("SELECT feature, mi, importance FROM (SELECT p_type AS feature, min(p_size) / 20000.0::double AS mi, avg(p_retailprice) AS importance, row_number() OVER (ORDER BY avg(p_retailprice), p_type) AS r, count(*) OVER () AS n FROM part GROUP BY p_type) WHERE mi < .001 AND r <= floor(n * .5)", "mi importance")
def weak_features(spark, sf):
    s = fx.table(spark, sf, "part").groupBy(F.col("p_type").alias("feature")).agg((F.min("p_size") / F.lit(20000.0)).alias("mi"), F.avg("p_retailprice").alias("importance"))
    return ml.weak_features(s)


# ---- loops of fits: every row of the v1 dataset, few trees


_FEW = {"trees": 5, "depth": 3}


@query()
def model_nested_cv(spark, sf):
    """Outer folds scored with the parameters that inner folds of their own training dates choose."""
    got = ml.nested_cv(_rows(spark, sf), features.BASE, "logistic", 2, 2, 2)
    return spark.createDataFrame([(g["fold"], g.get("accuracy"), g.get("roc_auc")) for g in got], "fold int, accuracy double, roc_auc double")


@query()
def model_tuning(spark, sf):
    """Every trial of a seeded search by Parzen estimators; the best is marked."""
    best, log = ml.tune("logistic", _rows(spark, sf), features.BASE, 7, 2)
    return spark.createDataFrame([(t["trial"], t["params"]["reg"], t["roc_auc"], t["params"] == best) for t in log], "trial int, reg double, roc_auc double, best boolean")


@query()
def model_rolling_origin(spark, sf):
    """One date ahead of every 250th origin, learning from all dates before."""
    return ml.rolling_origin(_rows(spark, sf), features.BASE, 504, 250, "logistic").select("symbol", "d", "fold", "probability", "predicted", "actual")


def newest_stability(spark, sf):
    """How stable a forest's prediction for each symbol's newest row is."""
    rows = _rows(spark, sf)
    model = ml.fit("random_forest", {"trees": 10, "depth": 3}, rows, features.BASE)
    newest = features.build(fx.bars(spark, sf), "v1").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("n = 1").drop("n")
    return ml.stability(model, newest, features.BASE)


@query()
def prediction_stability(spark, sf):
    """Spread of each symbol's newest probability when its features are shaken; the draws follow from symbol, date, trial and feature."""
    return newest_stability(spark, sf)


@query()
def risk_with_model(spark, sf):
    """risk_assessment with the stability of a model's predictions: they make up 40 % of the score, and unstable ones raise the level."""
    r = risk_assessment(spark, sf).join(newest_stability(spark, sf).select("symbol", "stability"), "symbol", "left")
    s, vs = F.coalesce("stability", F.lit(50.0)), F.col("volatility_score")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return r.select(
        "symbol", "volatility", "volatility_score", s.alias("stability"), clip(0.6 * vs + 0.4 * (100 - s)).alias("risk_score"), bands.escalated(F.col("risk_level"), s).alias("risk_level"),
        clip((100 - s) * 0.3 + vs * 0.1).alias("confidence_penalty"), "market_regime",
    )


@query()
def model_permutation(spark, sf):
    """Fall in accuracy when a feature's values are dealt anew."""
    rows = _rows(spark, sf)
    return ml.permutation_importance(ml.fit("random_forest", _FEW, rows, features.BASE), rows, features.BASE, 1)


@query()
def model_corrections(spark, sf):
    """Attempts after a failed gate, stopped at the first that passes: attempt, parameters, train and validation AUC, passed."""
    log = ml.attempt_corrections("random_forest", _FEW, ev.chronological_split(_rows(spark, sf), 0.7, 0.15), features.BASE)
    return spark.createDataFrame([(a["attempt"], a["change"], a["train_auc"], a["val_auc"], a["passed"]) for a in log], "attempt int, change string, train_auc double, val_auc double, passed boolean")


@query()
def model_windows(spark, sf):
    """Walk-forward results of several window lengths, rolling and expanding, side by side."""
    return ml.compare_windows(_rows(spark, sf), features.BASE, [(504, 252), (1008, 252)], "logistic", {})


@query()
def label_candidates(spark, sf):
    """Held-out metrics of a small forest for each kind of label."""
    df = features.build(fx.bars(spark, sf).withColumns({"next": labels.direction(), "up_5": labels.direction(5)}), "v1")
    df = _written(spark, df.select("symbol", "d", *features.BASE, "next", "up_5"), "candidates")
    got = ml.compare_labels({k: df.select("symbol", "d", *features.BASE, F.col(k).alias("label")) for k in ("next", "up_5")}, features.BASE)
    return spark.createDataFrame([(g["label"], g.get("accuracy"), g.get("roc_auc")) for g in got], "label string, accuracy double, roc_auc double")
