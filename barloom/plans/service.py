"""Composite queries: next-session predictions, experiment history, evaluation bundle, stability, search highlights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calendar as cal, evaluation as ev, features, models as ml, portfolio as pf, search
from ..sources import fixtures as fx
from .evaluate import _rows, preds, risk_assessment
from .registry import query

@query(
    """WITH l AS (SELECT 'P' || p_partkey || '.NS' AS symbol, replace(p_name, ' ', '-') AS name, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 8 END AS tier, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) END AS q FROM part)
 SELECT symbol, CASE tier WHEN 1 THEN nullif(regexp_extract(symbol, '(?i)(' || array_to_string(string_split(q, ''), '[^A-Za-z0-9]*') || ')', 1), '') WHEN 3 THEN nullif(regexp_extract(name, '(?i)(' || replace(trim(q), ' ', '[^A-Za-z0-9]*') || ')', 1), '') END AS matched FROM l"""
)
def search_highlight(spark, sf):
    """The part of each listing's symbol or name that a query fits, marks between letters or words allowed."""
    words, key = F.split("name", " "), F.regexp_extract("symbol", "[0-9]+", 0).cast("long")
    q = F.when(key % 3 == 0, F.concat(F.lit("p"), key.cast("string"))).otherwise(F.concat(F.get(words, F.lit(0)), F.lit(" "), F.coalesce(F.get(words, F.lit(1)), F.lit(""))))
    rows = fx.listing(spark, sf).select("symbol", F.replace("name", F.lit(" "), F.lit("-")).alias("name"), q.alias("q"), F.when(key % 3 == 0, 1).when(key % 3 == 1, 3).otherwise(8).alias("tier"))
    return rows.select("symbol", search.matched(text.normalize_query(F.col("q")), F.col("symbol"), F.col("name"), F.col("tier")).alias("matched"))


@query("SELECT symbol, sum(b)::double AS boost FROM (SELECT 'P' || p_partkey || '.NS' AS symbol, CASE WHEN p_partkey = 1 THEN .3 ELSE 0 END + CASE WHEN p_partkey IN (1, 2) THEN .5 ELSE 0 END + CASE WHEN p_partkey = 2 THEN .5 ELSE 0 END AS b FROM part) GROUP BY symbol", "boost")
def search_boost(spark, sf):
    return fx.listing(spark, sf).select("symbol", search.boost(["P1.NS"], ["P1.NS", "P2.NS"], ["P2.NS"]).alias("boost"))


@query("SELECT p_partkey AS id, p_brand AS family, p_retailprice AS metric FROM part WHERE p_brand = 'Brand#11' ORDER BY p_size DESC, p_partkey DESC")
def experiment_history(spark, sf):
    """Logged runs of a family, newest first."""
    return fx.table(spark, sf, "part").where("p_brand = 'Brand#11'").orderBy(F.desc("p_size"), F.desc("p_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), F.col("p_retailprice").alias("metric"))


@query()
def next_session(spark, sf):
    """Per symbol: direction and probability for the next session, confidence, freshness, live drift, risk, record so far, recommendation."""
    rows = _rows(spark, sf)
    model = ml.fit("random_forest", {"trees": 10, "depth": 3}, rows, features.BASE)
    newest = features.build(fx.bars(spark, sf), "v1").withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where("n = 1").drop("n")
    p = ev.confidence(ml.predict(model, newest.withColumn("label", F.lit(0.0))).select("symbol", "d", "probability"))
    expected = p.agg(F.max("d").alias("expected"))
    p = p.join(F.broadcast(expected)).withColumn("freshness", cal.freshness(cal.days_behind(F.col("d"), F.col("expected"))))
    record = preds(spark, sf)
    p = p.join(ev.concept_drift(record, 0.6, "symbol").select("symbol", F.col("status").alias("drift_status")), "symbol", "left")
    p = p.join(ev.performance(record, "symbol").select("symbol", "n", "accuracy"), "symbol", "left").join(risk_assessment(spark, sf).select("symbol", "risk_score", "risk_level", "market_regime"), "symbol", "left")
    p = p.join(pf.recent_swings(fx.bars(spark, sf)), "symbol", "left").withColumn("target", cal.next_trading_day(F.col("d")))
    return ml.recommendation(p).select("symbol", "d", "target", "prediction_class", "probability", "confidence_level", "freshness", "drift_status", "risk_level", "n", "accuracy", "stance", "key_risks")


@query()
def evaluation_bundle(spark, sf):
    """Metrics, confusion cells, learning curve, importances, attributions and leaks of one model version, as long rows."""
    return ml.bundle("random_forest", {"trees": 10, "depth": 3}, _rows(spark, sf), features.BASE)


@query("SELECT p_brand AS key, var_pop(p_retailprice) AS fold_variance, stddev_pop(p_size) AS probability_std, greatest(avg((p_size >= 25)::int), 1 - avg((p_size >= 25)::int)) AS agreement FROM part GROUP BY 1", "fold_variance probability_std agreement")
def stability_metrics(spark, sf):
    """Population variance of fold metrics, spread of probabilities, share that agrees with the majority."""
    t = fx.table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_retailprice").alias("metric"), F.col("p_size").cast("double").alias("probability"), (F.col("p_size") >= 25).cast("int").alias("predicted"))
    return ev.stability_metrics(t, "key")
