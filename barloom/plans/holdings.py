"""Queries that change portfolios, lots and watchlists, fill the bar store, and band what is explained of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import holdings as hd, search
from ..sources import fixtures as fx
from .market import B
from .registry import query

_LOTS = "WITH lots AS (SELECT o_orderkey AS id, o_custkey AS portfolio_id, 'S' || (o_orderkey % 40) AS symbol, o_totalprice / 100 AS shares, (o_orderkey % 97)::double AS avg_cost FROM orders)"


def _lots(spark, sf):
    """Orders as lots."""
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("portfolio_id"), F.concat(F.lit("S"), (k % 40).cast("string")).alias("symbol"), (F.col("o_totalprice") / 100).alias("shares"), (k % 97).cast("double").alias("avg_cost"))


@query(
    _LOTS + """, old AS (SELECT * FROM lots WHERE id % 4 <> 0), new AS (SELECT portfolio_id, 's' || (id % 40) AS symbol, CASE WHEN id % 28 = 0 THEN 'nan'::double WHEN id % 20 = 0 THEN 'inf'::double ELSE shares - 500 END AS shares, avg_cost - 3 AS avg_cost, id AS r FROM lots WHERE id % 4 = 0)
 SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY r), portfolio_id, upper(symbol), shares, avg_cost FROM new WHERE isfinite(shares) AND shares > 0 AND avg_cost >= 0"""
)
def holdings_added(spark, sf):
    """Lots with a batch of further ones: not finite, not positive or of negative cost are refused."""
    lots = _lots(spark, sf)
    shares = F.when(F.col("id") % 28 == 0, float("nan")).when(F.col("id") % 20 == 0, float("inf")).otherwise(F.col("shares") - 500)
    new = lots.where("id % 4 = 0").select("portfolio_id", F.lower("symbol").alias("symbol"), shares.alias("shares"), (F.col("avg_cost") - 3).alias("avg_cost"), F.col("id").alias("r"))
    return hd.add(lots.where("id % 4 <> 0"), new, "r")[0]


@query(_LOTS + " SELECT id, portfolio_id, symbol, CASE WHEN id % 3 = 0 AND shares > 700 THEN shares - 700 ELSE shares END AS shares, CASE WHEN id % 3 = 0 AND shares > 700 THEN 1.5 ELSE avg_cost END::double AS avg_cost FROM lots")
def holdings_updated(spark, sf):
    """New shares and cost by id. A change that isn't valid and one of an unknown id change nothing."""
    lots = _lots(spark, sf)
    changes = lots.where("id % 3 = 0").select("id", (F.col("shares") - 700).alias("shares"), F.lit(1.5).alias("avg_cost"))
    return hd.update(lots, changes.unionByName(changes.select(-F.col("id") - 1, "shares", "avg_cost").toDF("id", "shares", "avg_cost")))


@query(_LOTS + ", p AS (SELECT portfolio_id AS id, bool_or(id % 11 = 0) AS hit FROM lots GROUP BY 1) SELECT id, CASE WHEN hit THEN DATE '2024-06-01' ELSE DATE '2024-01-01' END AS updated_at FROM p")
def holdings_deleted(spark, sf):
    """When each portfolio was last touched, after lots were deleted."""
    lots = _lots(spark, sf)
    left = hd.delete(lots, lots.where("id % 11 = 0"))
    portfolios = lots.select(F.col("portfolio_id").alias("id")).distinct().withColumn("updated_at", F.lit("2024-01-01").cast("date"))
    return hd.touched(portfolios, lots, left, F.lit("2024-06-01").cast("date"))


@query(
    """WITH old AS (SELECT n_nationkey::bigint AS id, n_name AS name FROM nation), new AS (SELECT ' ' || lower(n_name) || ' ' AS name, n_nationkey AS r FROM nation UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'fund ' ELSE ' FUND ' END || (c_custkey // 4), 100 + c_custkey FROM customer),
 f AS (SELECT trim(name) AS name, r FROM new WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM old) QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY r) = 1)
 SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY r), name FROM f"""
)
def portfolios_created(spark, sf):
    """Names are unique in any case; the first of a batch takes one."""
    old = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    k = F.col("c_custkey")
    more = fx.table(spark, sf, "customer").select(F.concat(F.when(k % 2 == 0, "fund ").otherwise(" FUND "), F.floor(k / 4).cast("string")).alias("name"), (k + 100).cast("long").alias("r"))
    return hd.create(old, old.select(F.concat(F.lit(" "), F.lower("name"), F.lit(" ")).alias("name"), F.col("id").alias("r")).unionByName(more), "r")


@query("SELECT p_partkey AS ticker_id, p_size AS added_at, 'kept' AS list FROM part WHERE p_partkey % 6 IN (0, 2) AND p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, p_size, 'seeded' FROM part WHERE p_partkey <= 5")
def watchlist_changes(spark, sf):
    """A watchlist after additions (those that are there change nothing) and removals, which defaults don't refill; and an empty one, which they do."""
    p = fx.table(spark, sf, "part").selectExpr("p_partkey as ticker_id", "p_size as added_at")
    entries = hd.watch(p.where("ticker_id % 6 = 0"), p.where("ticker_id % 6 in (0, 2)").selectExpr("ticker_id", "if(ticker_id % 6 = 0, added_at + 9, added_at) as added_at"))
    defaults = p.where("ticker_id <= 5")
    kept = hd.seeded(hd.unwatch(entries, p.where("ticker_id % 10 = 0")), defaults)
    return kept.withColumn("list", F.lit("kept")).unionByName(hd.seeded(entries.limit(0), defaults).withColumn("list", F.lit("seeded")))


@query(
    B + """, u AS (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'Missing'), todo AS (SELECT symbol FROM u WHERE symbol NOT LIKE 'Brand#1%')
 SELECT symbol, CASE WHEN count(d) > 0 THEN 'completed' ELSE 'failed' END AS status, count(d) AS n FROM todo LEFT JOIN bars USING (symbol) GROUP BY symbol"""
)
def backfill_universe(spark, sf):
    """The checkpoint's new rows after a run that resumes: completed symbols are left alone, one without bars fails."""
    bars = fx.bars(spark, sf)
    every = bars.select("symbol").distinct()
    done = every.where("symbol like 'Brand#1%'").withColumn("status", F.lit("completed"))
    return hd.backfill(every.unionByName(spark.range(1).select(F.lit("Missing").alias("symbol"))), done, bars, bars.where("symbol like 'Brand#1%'"))[1]


@query(
    """WITH v AS (SELECT doc_id, (doc_id % 101) / 100.0 AS x, doc_id % 7 = 0 AS none FROM documents), l AS (SELECT *, CASE WHEN x < .2 THEN 'Low' WHEN x < .35 THEN 'Medium' WHEN x < .55 THEN 'High' ELSE 'Very High' END AS level FROM v)
 SELECT doc_id, CASE WHEN none THEN 'unavailable' ELSE 'neutral' END AS support, CASE WHEN none THEN NULL ELSE x / .8 - 1 END AS support_distance, CASE WHEN none THEN 'unavailable' ELSE 'neutral' END AS resistance, CASE level WHEN 'Low' THEN 'good' WHEN 'High' THEN 'worried' ELSE 'neutral' END AS portfolio_risk,
  CASE WHEN none THEN 'unavailable' WHEN x > .5 THEN 'pays' ELSE 'none' END AS dividend, CASE WHEN none THEN 'unavailable' WHEN x <= .3 THEN 'worried' ELSE 'neutral' END AS fundamentals,
  CASE WHEN x > .5 THEN 'up' ELSE 'down' END || ' in Monday, right ' || round_even(x * 10, 0)::int || ' of 10 times' AS prediction, CASE WHEN doc_id % 90 < 40 AND level IN ('Low', 'Medium') THEN 'High' ELSE level END AS risk_level FROM l""",
    "support_distance",
)
def explanation_levels(spark, sf):
    """Bands of price levels, risk, fundamentals and predictions; risk is raised where a prediction is unstable."""
    v = fx.table(spark, sf, "documents").select("doc_id", ((F.col("doc_id") % 101) / F.lit(100.0)).alias("x"), (F.col("doc_id") % 7 == 0).alias("none"))
    x, known = F.col("x"), F.when(~F.col("none"), F.col("x"))
    return v.select(
        "doc_id", bands.support(known, F.lit(0.8)).alias("support"), bands.distance(F.lit(0.8), known).alias("support_distance"), bands.resistance(F.lit(0.8), known).alias("resistance"), bands.portfolio_risk(bands.risk(x)).alias("portfolio_risk"),
        bands.dividend(known - 0.5).alias("dividend"), bands.fundamentals(known - 0.3, known).alias("fundamentals"), bands.prediction(x > 0.5, x, F.lit("Monday")).alias("prediction"),
        bands.escalated(bands.risk(x), F.col("doc_id") % 90).alias("risk_level"),
    )


_IX = fx.using("listing") + ", ix AS (SELECT symbol, upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\b(limited|ltd|company|corporation|corp)\\b\\.?', '', 'g'), '[&\\-.]', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean, upper(regexp_replace(symbol, '\\.NS$', '')) AS bare FROM listing UNION ALL SELECT 'NEWCO.BO', 'NEWCO', 'NEWCO')"


@query(_IX + " SELECT count(*) AS symbols, count(DISTINCT clean) AS names, count(*) FILTER (clean = '') AS nameless, count(*) FILTER (symbol LIKE '%.NS') AS nse, count(*) FILTER (symbol LIKE '%.BO') AS bse, count(*) - count(DISTINCT bare) AS shared_tickers FROM ix")
def search_health(spark, sf):
    """Counters of the index after one symbol was added; a listed one isn't added again."""
    listing = fx.listing(spark, sf)
    extra = spark.range(1).select(F.lit("NEWCO.BO").alias("symbol"), F.lit("Newco").alias("name")).unionByName(listing.limit(1).select("symbol", "name"))
    return search.health(search.prepare(listing, extra))


@query(
    """SELECT n_nationkey, CASE WHEN n IS NULL AND s IS NULL AND b IS NULL THEN 'Market index data isn''t available right now.' ELSE concat_ws(', ', 'Nifty 50 is ' || CASE WHEN n >= 0 THEN 'up ' ELSE 'down ' END || format('{:.1f}%', abs(n)) || ' today', 'Sensex is ' || CASE WHEN s >= 0 THEN 'up ' ELSE 'down ' END || format('{:.1f}%', abs(s)), 'Bank Nifty is ' || CASE WHEN b >= 0 THEN 'up ' ELSE 'down ' END || format('{:.1f}%', abs(b))) || '.' END || ' ' || n_name || ' leads your watchlist, up 2.5%.' AS summary
 FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey - 10)::double END AS n, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey - 12)::double END AS s, CASE WHEN n_nationkey % 5 = 0 THEN (n_nationkey - 7)::double END AS b FROM nation)"""
)
def market_clauses(spark, sf):
    """A clause for each index that has a change."""
    from ..functions import text

    k = F.col("n_nationkey")
    pct = lambda m, c: F.when(k % m == 0, (k - c) / F.lit(100.0))
    return fx.table(spark, sf, "nation").select("n_nationkey", text.market_summary(pct(2, 10), F.col("n_name"), F.lit(0.025), F.lit(None).cast("string"), F.lit(0.0), pct(3, 12), pct(5, 7)).alias("summary"))
