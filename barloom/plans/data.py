"""Queries of data quality, calendar, text, search, stores and ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, text
from ..operators import calendar as cal, indicators as ind, quality, search, store
from ..operators.windows import change
from ..sources import fixtures as fx, tables
from ..streaming import ticks as tk
from .market import B, RET, W
from .registry import query

# ---- quality


_DIRTY = fx.using("bars") + ", dirty AS (SELECT symbol, d, open, CASE WHEN volume % 17 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN volume % 19 = 0 THEN NULL ELSE close END AS close, CASE WHEN volume % 23 = 0 THEN -1 ELSE volume END::bigint AS volume, (dayofyear(d) + year(d) * 400) * 10 + CASE WHEN volume % 29 = 0 THEN -35 ELSE 0 END AS arrival FROM bars)"


def dirty(spark, sf):
    """Bars with planted faults."""
    v = F.col("volume")
    return fx.bars(spark, sf).select(
        "symbol", "d", "open", F.when(v % 17 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(v % 19 != 0, F.col("close")).alias("close"), F.when(v % 23 == 0, -1).otherwise(v).cast("long").alias("volume"),
        ((F.dayofyear("d") + F.year("d") * 400) * 10 + F.when(v % 29 == 0, -35).otherwise(0)).alias("arrival"),
    )


_REPORT = _DIRTY + f""", x AS (SELECT *, {RET} AS ret, d < lag(d) OVER (PARTITION BY symbol ORDER BY arrival) AS back FROM dirty),
 rep AS (SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT d) AS duplicate_dates, count(*) FILTER (back) AS out_of_order, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS missing_value_rows,
  count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < open OR high < close) AS high_below_body, count(*) FILTER (low > open OR low > close) AS low_above_body, count(*) FILTER (close <= 0) AS non_positive_close, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (abs(ret) > .4) AS outlier_days, min(d) AS first_date, max(d) AS last_date, count(*) >= 500 AS included FROM x GROUP BY symbol)"""


@query(_REPORT + " SELECT * FROM rep")
def quality_report(spark, sf):
    return quality.report(dirty(spark, sf), "arrival")


_TRADING = "(isodow(d) < 6)"


@query(B + f", m AS (SELECT symbol, d, {RET} AS move FROM bars) SELECT * FROM m WHERE abs(move) > .15", "move")
def unexplained_moves(spark, sf):
    return quality.large_moves(fx.bars(spark, sf))


_GAPS = ", cal AS (SELECT symbol, unnest(generate_series(min(d)::timestamp, max(d)::timestamp, INTERVAL 1 DAY))::date AS d FROM bars GROUP BY symbol), gaps AS (SELECT symbol, (SELECT count(*) FROM cal c WHERE c.symbol = s.symbol AND isodow(c.d) < 6 AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = c.symbol AND b.d = c.d)) AS missing_dates, count(*) FILTER (isodow(d) >= 6) AS non_trading_rows FROM bars s GROUP BY symbol)"


@query(B + _GAPS + " SELECT * FROM gaps")
def calendar_gaps(spark, sf):
    return quality.calendar_gaps(fx.bars(spark, sf)).withColumn("missing_dates", F.col("missing_dates").cast("long"))


@query(
    _REPORT + _GAPS.replace("bars", "dirty") + f""", mv AS (SELECT symbol, count(*) FILTER (abs(ret) > .15) AS moves FROM x GROUP BY symbol),
 wide AS (SELECT symbol, high_below_low + high_below_body + low_above_body + non_positive_close + negative_volume = 0 AS ohlc_integrity, duplicate_dates = 0 AS duplicate_row, missing_dates = 0 AS missing_date_calendar, non_trading_rows = 0 AS calendar_consistency,
  symbol < 'Brand#4' AS symbol_identity, negative_volume = 0 AS volume_anomaly, outlier_days = 0 AS price_anomaly, true AS adjusted_close_consistency, moves = 0 AS corporate_action_consistency, out_of_order = 0 AS timestamp_ordering FROM rep JOIN gaps USING (symbol) JOIN mv USING (symbol))
 SELECT symbol, check_name, passed FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE symbol) INTO NAME check_name VALUE passed)"""
)
def validation_checks(spark, sf):
    df = dirty(spark, sf)
    return quality.validate(df, df.select("symbol").where("symbol < 'Brand#4'"), "arrival")


@query(
    _REPORT + """, mv AS (SELECT symbol, count(*) FILTER (abs(ret) > .15) AS moves FROM x GROUP BY symbol),
 s AS (SELECT coalesce(100.0 * avg(1 - missing_value_rows / row_count) FILTER (included), 0) AS completeness, coalesce(100.0 * avg(CASE WHEN high_below_low + high_below_body + low_above_body + non_positive_close + negative_volume = 0 AND duplicate_dates = 0 THEN 1.0 ELSE 0.0 END) FILTER (included), 0) AS integrity,
  100.0 * count(*) FILTER (included) / count(*) AS coverage, avg(greatest(0.0, 100.0 - greatest(0, DATE '2001-11-06' - last_date - 3) * 5.0)) AS freshness, avg(CASE WHEN moves = 0 THEN 100.0 ELSE 0.0 END) AS corporate_action_validation FROM rep JOIN mv USING (symbol))
 SELECT round_even(completeness, 2) AS completeness, round_even(integrity, 2) AS integrity, round_even(coverage, 2) AS coverage, round_even(freshness, 2) AS freshness, round_even(corporate_action_validation, 2) AS corporate_action_validation,
  round_even((completeness + integrity + coverage + freshness + corporate_action_validation) / 5, 2) AS composite FROM s""",
    "completeness integrity coverage freshness corporate_action_validation composite",
)
def quality_score(spark, sf):
    return quality.score(dirty(spark, sf), F.lit("2001-11-06").cast("date"))


_CALLS = fx.using("calls")


@query(
    _CALLS + """, s AS (SELECT provider, list_sort(list(latency_ms)) AS l, count(*) AS calls, round_even(count(*) FILTER (success) / count(*), 2) AS success_rate, max(call_timestamp) FILTER (success) AS last_success,
  count(*) FILTER (failure_type = 'timeout') AS t FROM calls GROUP BY provider)
 SELECT provider, calls, success_rate, l[round_even((len(l) - 1) * .5, 0)::int + 1] AS p50, l[round_even((len(l) - 1) * .95, 0)::int + 1] AS p95, last_success, CASE WHEN t > 0 THEN 'timeout=' || t END AS failures FROM s""",
    "success_rate",
)
def provider_health(spark, sf):
    return quality.provider_health(fx.calls(spark, sf))


@query(B + "SELECT symbol, min(d) AS first_date, max(d) AS latest_date, count(*) AS row_count FROM bars GROUP BY symbol")
def metadata(spark, sf):
    """Checksums depend on how a double is written, so they stay out of the comparison."""
    return quality.metadata(fx.bars(spark, sf)).drop("checksum")


@query(B + ", p AS (SELECT symbol, count(*) AS n, min(d) AS a, max(d) AS z FROM bars GROUP BY symbol HAVING count(*) >= 500) SELECT sum(n)::bigint AS row_count, count(*) AS symbol_count, min(a) AS start_date, max(z) AS end_date FROM p")
def dataset_summary(spark, sf):
    return quality.dataset_summary(fx.bars(spark, sf))


# ---- calendar

_DAYS = f"days AS (SELECT unnest(generate_series(TIMESTAMP '2025-12-20', TIMESTAMP '2026-12-31', INTERVAL 1 DAY))::date AS d), t AS (SELECT d, isodow(d) < 6 AND d NOT IN ({', '.join(f'DATE {chr(39)}{x}{chr(39)}' for x in cal.HOLIDAYS)}) AS trading FROM days)"


#: Dates of shipments, moved into the year of the holidays.
_SHIPPED = "q AS (SELECT DISTINCT DATE '2026-01-01' + (date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS date)) % 353)::int AS d FROM lineitem)"


def shipped(spark, sf):
    day = F.pmod(F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")), F.lit(353))
    return fx.table(spark, sf, "lineitem").select(F.date_add(F.lit("2026-01-01").cast("date"), day).alias("d")).distinct()


@query(f"WITH {_DAYS}, {_SHIPPED} SELECT d, trading, (SELECT min(x.d) FROM t x WHERE x.trading AND x.d > t.d) AS next_d, (SELECT max(x.d) FROM t x WHERE x.trading AND x.d < t.d) AS prev_d FROM t WHERE d IN (SELECT d FROM q)")
def trading_days(spark, sf):
    c = F.col("d")
    return shipped(spark, sf).select("d", cal.is_trading_day(c).alias("trading"), cal.next_trading_day(c).alias("next_d"), cal.previous_trading_day(c).alias("prev_d"))


_LOCAL = "(ts + INTERVAL '5 hours 30 minutes')"


@query(f"SELECT event_id, CASE WHEN isodow({_LOCAL}) >= 6 OR {_LOCAL}::time < TIME '09:00:00' THEN 'closed' WHEN {_LOCAL}::time < TIME '09:15:00' THEN 'pre_open' WHEN date_trunc('second', {_LOCAL})::time <= TIME '15:30:00' THEN 'open' WHEN date_trunc('second', {_LOCAL})::time <= TIME '16:00:00' THEN 'post_close' ELSE 'closed' END AS phase FROM events")
def market_phase(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", cal.phase(F.col("ts")).alias("phase"))


@query(f"WITH {_DAYS}, {_SHIPPED}, b AS (SELECT d, least(60, (SELECT count(*) FROM t x WHERE x.trading AND x.d > q.d AND x.d <= DATE '2026-06-30'))::int AS behind FROM q) SELECT d, behind, CASE behind WHEN 0 THEN 'Fresh' WHEN 1 THEN 'Delayed' ELSE 'Stale' END AS freshness FROM b")
def freshness(spark, sf):
    """Of dates as the newest bar's, against the session of June 30th."""
    df = shipped(spark, sf).withColumn("behind", cal.days_behind(F.col("d"), F.lit("2026-06-30").cast("date")))
    return df.select("d", "behind", cal.freshness(F.col("behind")).alias("freshness"))


_TARGETS = f"WITH {_DAYS}, e AS (SELECT event_id, ({_LOCAL} + INTERVAL 2 YEAR)::date AS d FROM events), n AS (SELECT q.d, min(t.d) AS target FROM (SELECT DISTINCT d FROM e) q JOIN t ON t.trading AND t.d > q.d GROUP BY q.d) SELECT event_id, target FROM e LEFT JOIN n USING (d)"


@query(_TARGETS)
def prediction_target(spark, sf):
    """The session that follows each event, of all events."""
    return fx.table(spark, sf, "events").select("event_id", cal.target_session(F.expr("ts + interval 2 year")).alias("target"))


@query(_TARGETS)
def prediction_targets(spark, sf):
    """prediction_target under its former name."""
    return prediction_target(spark, sf)


# ---- text and search

_Q = "upper(trim(p_name))"


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(p_name || '-&. x.ns')), '\\.NS$', ''), '\\.BO$', ''), '[&\\-.]', ' ', 'g'), '\\s+', ' ', 'g')) AS q, trim(regexp_replace(regexp_replace(p_name || ' Ltd. Corp', '(?i)\\b(limited|ltd|company|corporation|corp)\\b\\.?', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalize(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", text.normalize_query(F.concat("p_name", F.lit("-&. x.ns"))).alias("q"), text.clean_name(F.concat("p_name", F.lit(" Ltd. Corp"))).alias("name"))


@query("SELECT symbol, CASE WHEN symbol LIKE '%.NS' THEN 'NSE' WHEN symbol LIKE '%.BO' THEN 'BSE' END AS exchange, symbol LIKE '%.NS' OR symbol LIKE '%.BO' AS supported FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'P' || p_partkey || '.NS' WHEN 1 THEN 'P' || p_partkey || '.BO' ELSE 'P' || p_partkey END AS symbol FROM part)")
def exchanges(spark, sf):
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    s = fx.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(key, F.lit(".NS"))).when(F.col("p_partkey") % 3 == 1, F.concat(key, F.lit(".BO"))).otherwise(key).alias("symbol"))
    return s.select("symbol", text.exchange(F.col("symbol")).alias("exchange"), text.is_supported(F.col("symbol")).alias("supported"))


_FAIL = [("Read TIMEOUT", "OSError"), ("HTTP 429", "HTTPError"), ("Rate limit hit", "HTTPError"), ("401 denied", "HTTPError"), ("Auth token", "ValueError"), ("404", "HTTPError"), ("thing not found", "KeyError"), ("reset by peer", "OSError"), ("404 missing columns", "MalformedResponse"), ("slow", "ReadTimed out")]


_FAILED = "SELECT doc_id, " + str([m for m, _ in _FAIL]) + "[doc_id % 10 + 1] || ': ' || coalesce(text, '') AS m, " + str([e for _, e in _FAIL]) + "[doc_id % 10 + 1] AS error FROM documents"


@query(
    "SELECT doc_id, CASE WHEN error = 'MalformedResponse' THEN 'malformed_response' WHEN contains(lower(m), 'timeout') OR contains(lower(error), 'timed out') THEN 'timeout' WHEN regexp_matches(lower(m), '429|rate limit|too many requests') THEN 'rate_limit' WHEN regexp_matches(lower(m), '401|403|auth') THEN 'auth' WHEN regexp_matches(lower(m), 'not found|404') THEN 'not_found' ELSE 'connection_error' END AS kind FROM (" + _FAILED + ")"
)
def failure_types(spark, sf):
    """Of messages that quote a response."""
    k = F.pmod("doc_id", F.lit(10)).cast("int")
    m = F.concat(F.get(F.array(*(F.lit(m) for m, _ in _FAIL)), k), F.lit(": "), F.coalesce("text", F.lit("")))
    return fx.table(spark, sf, "documents").select("doc_id", text.failure_type(m, F.get(F.array(*(F.lit(e) for _, e in _FAIL)), k)).alias("kind"))


_POS, _NEG = ("the", "and", "to"), ("of", "de", "in")
_SENT = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z'']+') AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and', 'to'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'de', 'in'))) AS n FROM w)"


@query(_SENT + " SELECT doc_id, CASE WHEN p + n = 0 THEN 0.0 ELSE round_even((p - n) / nullif(p + n, 0), 2) END AS score, CASE WHEN p + n = 0 THEN .2 ELSE round_even(least(.3 + .1 * (p + n), .7), 2) END AS confidence FROM c", "score confidence")
def rule_sentiment(spark, sf):
    s, c = text.sentiment(F.col("text"), _POS, _NEG)
    return fx.table(spark, sf, "documents").select("doc_id", s.alias("score"), c.alias("confidence"))


@query("SELECT doc_id, CASE WHEN s > .1 THEN 'Positive' WHEN s < -.1 THEN 'Negative' ELSE 'Neutral' END AS label FROM (SELECT doc_id, (doc_id % 11 - 5) / 10.0 AS s FROM documents)")
def sentiment_labels(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.sentiment_label((F.col("doc_id") % 11 - 5) / 10.0).alias("label"))


@query(fx.using("news") + "SELECT symbol, md5(headline) AS h, min(doc_id) AS doc_id FROM news n WHERE NOT EXISTS (SELECT 1 FROM news o WHERE o.doc_id % 3 = 0 AND o.symbol = n.symbol AND o.headline = n.headline) GROUP BY symbol, headline")
def unseen_headlines(spark, sf):
    """Headlines that aren't stored yet, the first of each in the batch."""
    n = fx.news(spark, sf).withColumn("h", F.md5("headline"))
    out = store.insert_ignore(n.where("doc_id % 3 = 0"), n, "symbol", "h", order=[F.col("doc_id")])
    return out.select("symbol", "h", "doc_id")


_ASKED = ["how is my portfolio", "best pharma pick", "compare these", "what is rsi", "is the market up", "tell me about it", "hello", "best of all", "Top bank stock"]
_SAYS = lambda words: "regexp_matches(q, '\\b(" + "|".join(words) + ")\\b')"


@query(
    f"SELECT p_partkey, CASE WHEN {_SAYS(text.PORTFOLIO)} THEN 'portfolio' WHEN n = 0 AND {_SAYS(text.RECOMMENDATION)} AND {_SAYS(text.SECTORS)} THEN 'sector_recommendation' WHEN n >= 2 THEN 'comparison' WHEN n = 0 AND {_SAYS(text.INDICATOR)} THEN 'indicator' WHEN n = 0 AND {_SAYS(text.MARKET)} THEN 'market' WHEN n > 0 THEN 'single_stock' ELSE 'general' END AS intent"
    f" FROM (SELECT p_partkey, (p_partkey % 27) // 9 AS n, lower({_ASKED!r}[p_partkey % 9 + 1] || ' ' || p_name) AS q FROM part)"
)
def intents(spark, sf):
    """Of questions about each part."""
    k = F.col("p_partkey")
    q = F.concat(F.get(F.array(*map(F.lit, _ASKED)), F.pmod(k, F.lit(9)).cast("int")), F.lit(" "), F.col("p_name"))
    return fx.table(spark, sf, "part").select("p_partkey", text.intent(q, F.floor(F.pmod(k, F.lit(27)) / 9)).alias("intent"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN x < 0 THEN '-' ELSE '' END) || '₹' || CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(w[:-4]), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END || '.' || right(format('{:.2f}', abs(x)), 2) AS shown FROM (SELECT *, floor(abs(x))::bigint::varchar AS w FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice - 30000) * 10 + .001 AS x FROM lineitem))")
def rupees(spark, sf):
    x = (F.col("l_extendedprice") - 30000) * 10 + 0.001
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.format_inr(x).alias("shown"))


_TERMS = ["P12", "almond", "a", "p1.ns", "pink-red", "lavender & x"]


@query(
    fx.using("listing") + f""", ix AS (SELECT symbol, name, upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\\b(limited|ltd|company|corporation|corp)\\b\\.?', '', 'g'), '[&\\-.]', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean, upper(regexp_replace(symbol, '\\.NS$', '')) AS bare FROM listing),
 q AS (SELECT t AS asked, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(t)), '\\.NS$', ''), '[&\\-.]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM (SELECT unnest({_TERMS!r}) AS t)),
 r AS (SELECT asked, symbol, name, CASE WHEN bare = replace(q, ' ', '') THEN 1 WHEN clean = q THEN 2 WHEN starts_with(clean, q) THEN 3 WHEN starts_with(bare, replace(q, ' ', '')) THEN 4 WHEN len(list_filter(string_split(clean, ' '), lambda x: starts_with(x, q))) > 0 THEN 5 WHEN contains(clean, q) THEN 6 WHEN contains(bare, replace(q, ' ', '')) THEN 7 END AS tier FROM ix, q)
 SELECT asked, symbol, tier, row_number() OVER (PARTITION BY asked ORDER BY tier, name, symbol)::int AS rank FROM r WHERE tier IS NOT NULL QUALIFY rank <= 5"""
)
def ranked_search(spark, sf):
    asked = spark.range(1).select(F.explode(F.array(*(F.lit(t) for t in _TERMS))).alias("q"))
    return search.search_many(search.prepare(fx.listing(spark, sf)), asked).select("asked", "symbol", "tier", "rank")


@query()
def fuzzy_search_many(spark, sf):
    """Best hits, fuzzy ones too, of misspelt names: every listing's name with a letter left out of each word."""
    listing = fx.listing(spark, sf)
    misspelt = F.array_join(F.transform(F.split("name", " "), lambda w: F.concat(F.substr(w, F.lit(1), F.lit(2)), F.substr(w, F.lit(4), F.length(w)))), " ")
    return search.search_many(search.prepare(listing), listing.select(misspelt.alias("q")).distinct(), fuzzy_too=True).select("asked", "symbol", "tier", "score", "rank")


@query()
def fuzzy_search(spark, sf):
    """One search with fuzzy scores for names that no tier fits; scores are tested against plain Python."""
    return search.search(search.prepare(fx.listing(spark, sf)), "smal gizmos")


@query(fx.using("listing") + "SELECT symbol, name FROM listing WHERE series IN ('Brand#11', 'Brand#12') AND (contains(lower(symbol), '1.') OR contains(lower(name), 'ur'))")
def watchlist_filter(spark, sf):
    """Sector in a list and text in symbol or name; the text is plain, not a pattern."""
    has = lambda c, t: F.lower(c).contains(t)
    return fx.listing(spark, sf).where(F.col("series").isin("Brand#11", "Brand#12") & (has("symbol", "1.") | has("name", "ur"))).select("symbol", "name")


@query(
    B + f""", s AS (SELECT symbol, close / lag(close, 21) {W} - 1 AS c, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM bars) SELECT symbol, c AS change_21 FROM s WHERE n = 1 AND symbol LIKE 'Brand#1%' ORDER BY c DESC NULLS LAST, symbol LIMIT 5""",
    "change_21",
)
def sector_shortlist(spark, sf):
    from .market import latest_snapshot

    return latest_snapshot(spark, sf).where("symbol like 'Brand#1%'").orderBy(F.col("change_21").desc_nulls_last(), "symbol").limit(5).select("symbol", "change_21")


@query(
    """WITH v AS (SELECT doc_id, (doc_id % 101) / 100.0 AS x FROM documents) SELECT doc_id,
  CASE WHEN x * 100 >= 70 THEN 'overbought' WHEN x * 100 <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi, CASE WHEN x >= .45 THEN 'high' WHEN x <= .2 THEN 'low' ELSE 'moderate' END AS volatility, CASE WHEN x * 100 >= 25 THEN 'strong' ELSE 'weak' END AS adx,
  CASE WHEN x * 2 >= 1 THEN 'good' WHEN x * 2 <= 0 THEN 'poor' ELSE 'moderate' END AS sharpe, CASE WHEN x >= .3 THEN 'deep' WHEN x <= .1 THEN 'shallow' ELSE 'moderate' END AS drawdown, CASE WHEN x * 100 >= 70 THEN 'good' WHEN x * 100 < 40 THEN 'concentrated' ELSE 'moderate' END AS diversification,
  CASE WHEN x * 100 - 20 <= 0 THEN 'loss' WHEN x * 100 - 20 > 40 THEN 'expensive' WHEN x * 100 - 20 < 10 THEN 'cheap' ELSE 'typical' END AS price_earnings, CASE WHEN x - .5 > .15 THEN 'good' WHEN x - .5 < -.15 THEN 'worried' ELSE 'neutral' END AS sentiment,
  CASE WHEN x / 20 >= .03 THEN 'worried' WHEN x / 20 <= .015 THEN 'good' ELSE 'neutral' END AS atr, CASE WHEN x >= .6 THEN 'above' WHEN x <= .4 THEN 'below' ELSE 'inside' END AS bollinger, CASE WHEN x > .5 THEN 'above' ELSE 'below' END AS vwap,
  CASE WHEN x > .6 AND x - .5 > 0 THEN 'strong_up' WHEN x > .6 THEN 'turning_up' WHEN x - .5 < 0 THEN 'strong_down' ELSE 'turning_down' END AS macd, CASE WHEN x * 100 >= 70 THEN 'Hot' WHEN x * 100 <= 30 THEN 'Cold' ELSE 'Balanced' END AS badge FROM v"""
)
def explanation_bands(spark, sf):
    v = fx.table(spark, sf, "documents").select("doc_id", ((F.col("doc_id") % 101) / F.lit(100.0)).alias("x"))
    x = F.col("x")
    return v.select(
        "doc_id", bands.rsi(x * 100).alias("rsi"), bands.volatility(x).alias("volatility"), bands.adx(x * 100).alias("adx"), bands.sharpe(x * 2).alias("sharpe"), bands.drawdown(x).alias("drawdown"), bands.diversification(x * 100).alias("diversification"),
        bands.price_earnings(x * 100 - 20).alias("price_earnings"), bands.sentiment(x - 0.5).alias("sentiment"), bands.atr(x / 20, F.lit(1.0)).alias("atr"), bands.bollinger(x, F.lit(0.6), F.lit(0.4)).alias("bollinger"), bands.vwap(x, F.lit(0.5)).alias("vwap"),
        F.when(x > 0.6, bands.macd(x - 0.5, F.lit(-1.0))).otherwise(bands.macd(x - 0.5, F.lit(1.0))).alias("macd"), bands.rsi_badge(x * 100).alias("badge"),
    )


# ---- stores

_NEW = fx.using("bars") + ", old AS (SELECT * FROM bars WHERE year(d) < 1998), batch AS (SELECT symbol, d, open, high, low, CASE WHEN volume % 7 = 0 THEN NULL ELSE close END AS close, volume, 0.0 AS dividend, 1 AS src FROM bars WHERE year(d) IN (1997, 1998) UNION ALL SELECT symbol, d, open, high, low, close, volume + 1, 2.5, 2 FROM bars WHERE year(d) = 1998)"


@query(_NEW + " SELECT symbol, d, close, volume, nullif(dividend, 0)::double AS dividend FROM batch b WHERE close IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old o WHERE o.symbol = b.symbol AND o.d = b.d) QUALIFY row_number() OVER (PARTITION BY symbol, d ORDER BY src) = 1")
def insert_bars(spark, sf):
    b = fx.bars(spark, sf)
    first = b.where("year(d) in (1997, 1998)").withColumns({"close": F.when(F.col("volume") % 7 != 0, F.col("close")), "dividend": F.lit(0.0), "src": F.lit(1)})
    second = b.where("year(d) = 1998").withColumns({"volume": F.col("volume") + 1, "dividend": F.lit(2.5), "src": F.lit(2)})
    return store.insert_bars(b.where("year(d) < 1998"), first.unionByName(second), [F.col("src")]).select("symbol", "d", "close", "volume", "dividend")


_IDS = "SELECT 'FIN-' || CASE WHEN n > 9999 THEN n::varchar ELSE lpad(n::varchar, 4, '0') END AS internal_id, 'C' || c_custkey AS symbol FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 7 AS n FROM customer WHERE c_custkey > 10)"


@query(_IDS)
def register_tickers(spark, sf):
    """Ids for every customer that has none; the first ten are registered already."""
    c = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    return store.numbered(c.join(c.where("c_custkey <= 10").select("symbol"), "symbol", "left_anti"), 7, "c_custkey").select("internal_id", "symbol")


@query(_IDS)
def register_all_tickers(spark, sf):
    """register_tickers under its former name."""
    return register_tickers(spark, sf)


def _registry(spark, sf):
    s = fx.table(spark, sf, "nation")
    empty = "cast(array() as array<struct<old_symbol:string,new_symbol:string,effective_date:date,reason:string>>)"
    return s.selectExpr("concat('FIN-', n_nationkey) as internal_id", "n_name as current_symbol", "array(concat('OLD', n_nationkey % 20)) as historical_symbols", f"{empty} as rename_history", "cast(array() as array<struct<counterpart:string,transaction_type:string,effective_date:date>>) as merger_history")


@query("SELECT 'FIN-' || n_nationkey AS internal_id, CASE WHEN n_nationkey % 5 = 0 THEN 'NEW' || n_nationkey ELSE n_name END AS current_symbol, CASE WHEN n_nationkey % 5 = 0 THEN 'OLD' || (n_nationkey % 20) || ',' || n_name ELSE 'OLD' || (n_nationkey % 20) END AS history, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS renames, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS mergers FROM nation")
def rename_and_merge(spark, sf):
    r = _registry(spark, sf)
    n = fx.table(spark, sf, "nation")
    changes = n.where("n_nationkey % 5 = 0").selectExpr("concat('FIN-', n_nationkey) as internal_id", "concat('NEW', n_nationkey) as new_symbol", "date '2020-01-01' as effective_date", "cast(null as string) as reason")
    mergers = n.where("n_nationkey % 3 = 0").selectExpr("concat('FIN-', n_nationkey) as internal_id", "'FIN-x' as counterpart", "'merger' as transaction_type", "date '2021-01-01' as effective_date")
    return store.merge(store.rename(r, changes), mergers).select("internal_id", "current_symbol", F.array_join("historical_symbols", ",").alias("history"), F.size("rename_history").alias("renames"), F.size("merger_history").alias("mergers"))


@query("WITH a AS (SELECT n_name AS symbol, n_nationkey AS k, 0 AS r FROM nation UNION ALL SELECT 'OLD' || (n_nationkey % 20), n_nationkey, 1 FROM nation), q AS (SELECT n_name AS symbol FROM nation UNION ALL SELECT 'OLD' || n_nationkey FROM nation) SELECT q.symbol, min('FIN-' || k) AS internal_id, count(k) AS n FROM q LEFT JOIN a ON a.symbol = q.symbol AND a.r = (SELECT min(r) FROM a x WHERE x.symbol = q.symbol) GROUP BY q.symbol")
def resolve_symbols(spark, sf):
    n = fx.table(spark, sf, "nation")
    return store.resolve(_registry(spark, sf), n.selectExpr("n_name as symbol").unionByName(n.selectExpr("concat('OLD', n_nationkey) as symbol")))


@query("SELECT p_brand AS model_name, p_partkey AS id, p_type AS version, p_type = arg_max(p_type, p_partkey) OVER (PARTITION BY p_brand) AS is_active FROM part")
def active_models(spark, sf):
    return store.activate(fx.table(spark, sf, "part").selectExpr("p_brand as model_name", "p_partkey as id", "p_type as version"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def checkpoint_remaining(spark, sf):
    c = fx.table(spark, sf, "customer")
    return store.remaining(c, c.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 0")
def cascade_delete(spark, sf):
    c, o = fx.table(spark, sf, "customer").withColumnRenamed("c_custkey", "k"), fx.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    left, rest = store.remove(c, o, c.where("k % 10 = 0").select("k"), "k")
    return rest.agg(F.count("*").alias("n")).selectExpr("'orders' as t", "n").unionByName(left.agg(F.count("*").alias("n")).selectExpr("'customer' as t", "n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, ok FROM (SELECT *, shares > 0 AND cost >= 0 AND isfinite(shares) AND isfinite(cost) AS ok FROM (SELECT *, l_quantity - 3 AS shares, l_discount - .02 AS cost FROM lineitem)) WHERE ok")
def valid_holdings(spark, sf):
    line = fx.table(spark, sf, "lineitem").withColumns({"shares": F.col("l_quantity") - 3, "cost": F.col("l_discount") - 0.02})
    return tables.valid_holdings(line).select("l_orderkey", "l_linenumber", "l_partkey", F.lit(True).alias("ok"))


@query(B + "SELECT symbol, d, close FROM bars WHERE symbol = 'Brand#23' AND year(d) BETWEEN 1996 AND 1997 AND d >= DATE '1996-03-01' AND d <= DATE '1997-02-28'")
def parquet_store(spark, sf):
    """All bars, written by symbol and year; one symbol's read back with partition pruning and an exact date filter."""
    path = tables.shared(spark, "bars")
    tables.write_bars(fx.bars(spark, sf), path)
    return tables.read_bars(spark, path, "brand#23", "1996-03-01", "1997-02-28").select("symbol", "d", "close")


@query("SELECT event_id, (props::json ->> 'k')::int AS k FROM events")
def json_props(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---- ticks

_TICKS = fx.using("ticks")


def _seen(key: str) -> str:
    """CTE s: the ticks in order, and whether a key is among the last 500 distinct ones of its symbol."""
    return fx.using("ticks", recursive=True) + f""", o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS r FROM ticks),
 w AS (SELECT symbol, r, [{key}] AS seen, false AS dup FROM o WHERE r = 1 UNION ALL
  SELECT o.symbol, o.r, CASE WHEN list_contains(w.seen, o.{key}) THEN w.seen ELSE list_append(w.seen, o.{key})[-500:] END, list_contains(w.seen, o.{key}) FROM w JOIN o ON o.symbol = w.symbol AND o.r = w.r + 1),
 s AS MATERIALIZED (SELECT o.*, w.dup FROM o JOIN w USING (symbol, r))"""


@query(
    _seen("sequence_id") + """,
 h AS (SELECT *, max(sequence_id) FILTER (NOT dup) OVER w AS last_seq, max(exchange_ts) FILTER (NOT dup) OVER w AS last_ts FROM s WINDOW w AS (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT symbol, sequence_id, arrival, CASE WHEN dup THEN 'DUPLICATE' WHEN last_seq IS NULL OR sequence_id = last_seq + 1 THEN 'ACCEPT' WHEN sequence_id > last_seq THEN 'GAP' WHEN exchange_ts >= last_ts THEN 'ACCEPT' ELSE 'OUT_OF_ORDER' END AS outcome,
  CASE WHEN NOT dup AND sequence_id > last_seq THEN sequence_id - last_seq - 1 ELSE 0 END AS gap FROM h"""
)
def tick_outcomes(spark, sf):
    return tk.classify(fx.ticks(spark, sf)).select("symbol", "sequence_id", "arrival", "outcome", "gap")


_BYTIME = _seen("exchange_ts") + ", t AS (SELECT *, CASE WHEN dup THEN 'DUPLICATE' WHEN exchange_ts > coalesce(max(exchange_ts) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '1900-01-01') THEN 'ACCEPT' ELSE 'OUT_OF_ORDER' END AS outcome FROM s)"


@query(_BYTIME + " SELECT symbol, sequence_id, arrival, outcome FROM t")
def tick_outcomes_by_time(spark, sf):
    return tk.classify_by_time(fx.ticks(spark, sf)).select("symbol", "sequence_id", "arrival", "outcome")


@query(_BYTIME + " SELECT symbol, outcome, count(*) AS n FROM t GROUP BY 1, 2")
def tick_counters(spark, sf):
    return tk.classify_by_time(fx.ticks(spark, sf)).groupBy("symbol", "outcome").agg(F.count("*").alias("n"))


@query(_TICKS + "SELECT symbol, arg_max(ltp, arrival) FILTER (sequence_id % 3 <> 0) AS ltp, arg_max(sequence_id, arrival) FILTER (sequence_id % 7 <> 0) AS seq FROM ticks GROUP BY symbol")
def latest_ticks(spark, sf):
    t = fx.ticks(spark, sf).select("symbol", "arrival", F.when(F.col("sequence_id") % 3 != 0, F.col("ltp")).alias("ltp"), F.when(F.col("sequence_id") % 7 != 0, F.col("sequence_id")).alias("seq"))
    return tk.merge_latest(t, "ltp", "seq")


@query(_TICKS + "SELECT symbol, time_bucket(INTERVAL 1 HOUR, exchange_ts) AS start, arg_min(ltp, (exchange_ts, sequence_id)) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, (exchange_ts, sequence_id)) AS close, count(*) AS ticks FROM ticks GROUP BY 1, 2")
def tick_bars(spark, sf):
    return tk.minute_bars(fx.ticks(spark, sf), width="1 hour")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_ms(event_id * 1000003)::timestamp END AS at FROM events")
def epoch_times(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("n/a")).otherwise((F.col("event_id") * 1000003).cast("string"))
    return fx.table(spark, sf, "events").select("event_id", tk.epoch_ms(raw).alias("at"))


@query(_TICKS + "SELECT symbol, ltp, ltp / 50 - 1 AS change FROM (SELECT symbol, arg_max(ltp, arrival) AS ltp FROM ticks GROUP BY symbol)", "change")
def live_change(spark, sf):
    t = fx.ticks(spark, sf)
    return tk.live_change(t, t.select("symbol").distinct().withColumn("close", F.lit(50.0))).select("symbol", "ltp", "change")
