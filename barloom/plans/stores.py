"""Queries of feature stores, manifests, lookups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, lookup, search, store
from ..sources import fixtures as fx, tables
from .market import B, _FEATURES, _SMOOTH
from .registry import query


@query(_SMOOTH + _FEATURES + " SELECT symbol, d, lag_return_1, rsi_14, label FROM feats WHERE label IS NOT NULL AND symbol = 'Brand#12' AND " + " AND ".join(f"{c} IS NOT NULL" for c in features.BASE), "lag_return_1 rsi_14")
def feature_store(spark, sf):
    """Features of all symbols written as JSON under a version, rows already stored skipped; one symbol's read back."""
    path = tables.shared(spark, "features")
    df = features.dataset(fx.bars(spark, sf), "v1")
    tables.write_features(df.where("d < date '1998-01-01'"), path, "v1")
    tables.write_features(df, path, "v1", spark.read.parquet(path))
    return tables.read_features(spark, path, "v1", features.BASE).where("symbol = 'Brand#12'").select("symbol", "d", "lag_return_1", "rsi_14", "label")


@query(B + "SELECT count(*) AS row_count, count(DISTINCT symbol) AS symbols, min(d)::varchar AS start_date, max(d)::varchar AS end_date FROM bars")
def manifest(spark, sf):
    """The manifest's JSON, written and read again."""
    path = tables.shared(spark, "manifest")
    tables.manifest(fx.bars(spark, sf), "v1").select("value").write.text(path)
    m = spark.read.schema("row_count long, symbols array<string>, start_date string, end_date string").json(path)
    return m.select("row_count", F.size("symbols").cast("long").alias("symbols"), "start_date", "end_date")


@query("SELECT p_partkey AS ticker_id, CASE WHEN p_partkey % 4 = 0 THEN 'kept' WHEN p_partkey % 3 = 0 THEN 'FIN-' || p_partkey END AS internal_id FROM part")
def backfill_ids(spark, sf):
    p = fx.table(spark, sf, "part")
    prices = p.select(F.col("p_partkey").alias("ticker_id"), F.when(F.col("p_partkey") % 4 == 0, "kept").alias("internal_id"))
    tickers = p.selectExpr("p_partkey as ticker_id", "concat('T', p_partkey) as symbol")
    registry = p.where("p_partkey % 3 = 0").selectExpr("concat('T', p_partkey) as current_symbol", "concat('FIN-', p_partkey) as internal_id")
    return lookup.backfill_ids(prices, tickers, registry).select("ticker_id", "internal_id")


@query("SELECT 'P' || p_partkey || '.NS' AS symbol, p_name AS name, p_size AS added_at FROM part WHERE p_partkey % 20 = 0")
def watchlist(spark, sf):
    p = fx.table(spark, sf, "part")
    return lookup.watchlist(p.where("p_partkey % 20 = 0").selectExpr("p_partkey as ticker_id", "p_size as added_at"), fx.listing(spark, sf).withColumn("ticker_id", F.regexp_extract("symbol", r"\d+", 0).cast("long")))


_WANTED = "(VALUES ('P1'), ('p12'), ('red widget'), ('nothing')) w(wanted_symbol)"


@query(
    f"""WITH i AS (SELECT p_partkey AS token, 'P' || p_partkey AS trading_symbol, p_name AS name FROM part), r AS (SELECT wanted_symbol, 'NSE' AS segment, token, trading_symbol,
  CASE WHEN upper(trading_symbol) = upper(wanted_symbol) THEN 1 WHEN upper(name) = upper(wanted_symbol) THEN 2 WHEN starts_with(upper(trading_symbol), upper(wanted_symbol)) THEN 3 END AS rank FROM i, {_WANTED})
 SELECT wanted_symbol, segment, token, trading_symbol, rank FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted_symbol ORDER BY rank, length(trading_symbol), token) = 1"""
)
def instrument_lookup(spark, sf):
    i = fx.table(spark, sf, "part").selectExpr("p_partkey as token", "concat('P', p_partkey) as trading_symbol", "p_name as name", "'NSE' as segment")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, ("P1", "p12", "red widget", "nothing")))).alias("symbol"), F.lit("NSE").alias("segment"))
    return lookup.instrument(i, wanted)


@query("SELECT * FROM (VALUES ('p5', 'P5.NS'), ('abc.ns', 'ABC.NS'), ('P7.NS', 'P7.NS'), ('zzz none', NULL)) t(text, symbol)")
def resolve_text(spark, sf):
    texts = spark.range(1).select(F.explode(F.array(*map(F.lit, ("p5", "abc.ns", "P7.NS", "zzz none")))).alias("text"))
    return lookup.resolve_text(texts, search.prepare(fx.listing(spark, sf)))


@query("SELECT * FROM (VALUES ('compare P12 and P7 please', 'P12.NS,P7.NS'), ('what is the outlook for P3', 'P3.NS'), ('hello', '')) t(question, symbols)")
def extract_symbols(spark, sf):
    qs = spark.range(1).select(F.explode(F.array(*map(F.lit, ("compare P12 and P7 please", "what is the outlook for P3", "hello")))).alias("question"))
    return lookup.extract_symbols(qs, search.prepare(fx.listing(spark, sf))).select("question", F.array_join("symbols", ",").alias("symbols"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 'Market index data isn''t available right now.' ELSE 'Nifty 50 is ' || CASE WHEN n_nationkey >= 10 THEN 'up' ELSE 'down' END || ' ' || format('{:.1f}', abs(n_nationkey - 10) * 1.0) || '% today.' END || ' ' || n_name || ' leads your watchlist, up 2.5%' || CASE WHEN n_nationkey < 12 THEN '; X is your weakest, down 1.5%' ELSE '' END || '.' AS summary FROM nation")
def market_summary(spark, sf):
    k = F.col("n_nationkey")
    pct = F.when(k % 4 != 3, (k - 10) / F.lit(100.0))
    return fx.table(spark, sf, "nation").select("n_nationkey", text.market_summary(pct, F.col("n_name"), F.lit(0.025), F.lit("X"), F.when(k < 12, -0.015).otherwise(0.01)).alias("summary"))


@query("SELECT p_name AS symbol, min(p_brand) AS name FROM part GROUP BY p_name UNION ALL SELECT '^NSEI', '^NSEI'")
def universe_list(spark, sf):
    """A reference list as CSV with untidy headers and repeated symbols, read with a benchmark in front."""
    path = tables.shared(spark, "universe")
    p = fx.table(spark, sf, "part")
    tables.write_csv(p.select(F.concat(F.lit(" "), "p_name").alias(" SYMBOL "), F.concat("p_brand", F.lit("  ")).alias("Name"), F.col("p_type").alias("Series ")), path)
    return tables.read_universe(spark, path, "", ("^NSEI",)).select("symbol", "name")


@query("SELECT 'P' || p_partkey AS symbol, p_size - 3.0::double AS shares, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS cost FROM part WHERE p_size > 3 AND p_size <> 9 AND p_partkey % 7 <> 0")
def holdings_import(spark, sf):
    """Holdings CSV: headers in any case, unknown symbols and shares that are no positive number skipped, a missing cost 0."""
    path = tables.shared(spark, "holdings")
    p = fx.table(spark, sf, "part")
    tables.write_csv(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("Symbol"), F.when(F.col("p_size") == 9, "nine").otherwise((F.col("p_size") - 3).cast("string")).alias("SHARES"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("avg_cost")), path)
    known = p.where("p_partkey % 7 <> 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"))
    return tables.read_holdings(spark, path, known)[0]


_PROGRESS = "p AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'validate' ELSE 'ingest' END AS stage, c_custkey AS internal_id, 'completed' AS status, c_nationkey AS processed FROM customer WHERE c_custkey % 4 = 0)"


@query(
    f"WITH {_PROGRESS}, u AS (SELECT c_custkey AS internal_id, c_nationkey + 1 AS processed FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT c_custkey AS internal_id, 'status ' || (c_custkey % 5) AS reason, c_nationkey AS processed FROM customer WHERE c_custkey % 7 = 0)"
    " SELECT internal_id, status, NULL::varchar AS reason, processed FROM p WHERE stage = 'ingest' AND internal_id NOT IN (SELECT internal_id FROM u) UNION ALL SELECT internal_id, 'completed', NULL, processed FROM u UNION ALL SELECT internal_id, 'failed', reason, processed FROM f UNION ALL SELECT internal_id, 'failed', reason, processed FROM f"
)
def checkpoint_progress(spark, sf):
    """A stage resumed: units marked as completed twice count once, each failure counts."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("internal_id"), F.col("c_nationkey").alias("at"))
    k = F.col("internal_id")
    had = c.where(k % 4 == 0).select(F.when(k % 3 == 0, "validate").otherwise("ingest").alias("stage"), "internal_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"), "at")
    done = c.where(k % 2 == 0).withColumn("at", F.col("at") + 1)
    failed = c.where(k % 7 == 0).withColumn("reason", F.concat(F.lit("status "), (k % 5).cast("string")))
    out = store.mark_completed(store.enter_stage(had, "ingest"), done.unionByName(c.where(k % 2 == 0)), "ingest")
    out = store.mark_failed(store.mark_failed(out, failed, "ingest"), failed, "ingest")
    return out.select("internal_id", "status", "reason", F.col("at").alias("processed"))


@query(
    """WITH r AS (SELECT p_partkey AS feature_name, 'active' AS status, NULL::varchar AS reason, 'e' || p_size AS evidence FROM part WHERE p_partkey % 3 <> 0),
 c AS (SELECT p_partkey AS feature_name, CASE WHEN p_size < 20 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN p_size < 20 THEN 'weak' END AS reason, CASE WHEN p_size % 2 = 0 THEN 'mi ' || p_size END AS evidence FROM part WHERE p_partkey % 2 = 0)
 SELECT feature_name, coalesce(c.status, r.status) AS status, CASE WHEN c.status = 'deprecated' THEN c.reason ELSE r.reason END AS reason, CASE WHEN c.status = 'deprecated' THEN c.evidence ELSE coalesce(c.evidence, r.evidence) END AS evidence FROM r FULL JOIN c USING (feature_name)"""
)
def feature_registry(spark, sf):
    """Features deprecated with reason and evidence, or confirmed; those without a row get one."""
    p, size = fx.table(spark, sf, "part"), F.col("p_size")
    name, text_of = F.col("p_partkey").alias("feature_name"), lambda t: F.concat(F.lit(t), size.cast("string"))
    had = p.where("p_partkey % 3 <> 0").select(name, F.lit("active").alias("status"), F.lit(None).cast("string").alias("reason"), text_of("e").alias("evidence"))
    new = p.where("p_partkey % 2 = 0").select(name, F.when(size < 20, "deprecated").otherwise("active").alias("status"), F.when(size < 20, "weak").alias("reason"), F.when(size % 2 == 0, text_of("mi ")).alias("evidence"))
    return store.set_features(had, new)


@query("SELECT p_partkey AS version, p_brand AS model_name, CASE WHEN p_partkey % 4 = 0 THEN ['active', 'testing', 'archived'][p_size % 3 + 1] ELSE 'active' END AS status FROM part")
def model_statuses(spark, sf):
    """Models after changes of status; unknown versions and statuses change nothing."""
    p = fx.table(spark, sf, "part")
    models = p.select(F.col("p_partkey").alias("version"), F.col("p_brand").alias("model_name"), F.lit("active").alias("status"))
    asked = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("version"), F.get(F.array(*map(F.lit, store.MODEL_STATUSES)), (F.col("p_size") % 3).cast("int")).alias("status"))
    wrong = p.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("version"), F.lit("gone").alias("status")).unionByName(p.select((-F.col("p_partkey") - 1).alias("version"), F.lit("testing").alias("status")))
    return store.set_model_status(models, asked.unionByName(wrong))[0]
