"""Market-data views over the driver's tables: bars, sectors, ticks, lots, calls, listings, news. See FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price():
    return F.col("l_extendedprice") / F.col("l_quantity")


def ohlcv(trades: DataFrame, *keys: str) -> DataFrame:
    """Bars of trades: first and last price by order, extremes, summed volume. One partial aggregate before the shuffle."""
    price, volume = _price(), "l_quantity"
    # (order, line, part) in one long: buffers of fixed width keep this a hash aggregate, where a struct would sort all trades
    order = F.shiftleft("l_orderkey", 30).bitwiseOR(F.shiftleft(F.col("l_linenumber").cast("long"), 26)).bitwiseOR(F.col("l_partkey"))
    return trades.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).cast("long").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, open, high, low, close, volume."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    trades = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("d", F.to_date("l_shipdate"))
    return ohlcv(trades, "symbol", "d")


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars by nation of the supplier, with its region as sector."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select("s_suppkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    trades = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("d", F.to_date("l_shipdate"))
    return ohlcv(trades, "symbol", "sector", "d")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks; every 50th is delivered twice, every 37th late, and every 211th once more when some thousand others have come."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("ltp"), F.col("ts").alias("exchange_ts"), F.col("event_id").alias("sequence_id"))
    late = F.when(F.col("sequence_id") % 37 == 0, F.col("sequence_id") + 200.5).otherwise(F.col("sequence_id").cast("double"))
    again = e.where(F.col("sequence_id") % 50 == 0).withColumn("arrival", F.col("sequence_id") + 3.5)
    old = e.where(F.col("sequence_id") % 211 == 0).withColumn("arrival", F.col("sequence_id") + 4000.25)
    return e.withColumn("arrival", late).unionByName(again).unionByName(old)


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return line.select(F.col("o_custkey").alias("portfolio_id"), F.col("p_brand").alias("symbol"), F.col("l_quantity").alias("shares"), _price().alias("avg_cost"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("ts").alias("call_timestamp"), (~error).alias("success"), F.floor("value").cast("long").alias("latency_ms"), F.when(error, "timeout").alias("failure_type")
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.lit(".NS")).alias("symbol"), F.col("p_name").alias("name"), F.col("p_brand").alias("series"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("headline"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("d"), F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"))


#: The same views for DuckDB, as common table expressions.
_ROW = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_BAR = f"arg_min(l_extendedprice / l_quantity, {_ROW}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {_ROW}) AS close, CAST(sum(l_quantity) AS bigint) AS volume"
VIEWS = {
    "bars": f"SELECT p_brand AS symbol, CAST(l_shipdate AS date) AS d, {_BAR} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "sector_bars": f"SELECT n_name AS symbol, r_name AS sector, CAST(l_shipdate AS date) AS d, {_BAR} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3",
    "ticks": "SELECT event_type AS symbol, value AS ltp, ts AS exchange_ts, event_id AS sequence_id, CASE WHEN event_id % 37 = 0 THEN event_id + 200.5 ELSE event_id END::double AS arrival FROM events UNION ALL SELECT event_type, value, ts, event_id, (event_id + 3.5)::double FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_type, value, ts, event_id, event_id + 4000.25 FROM events WHERE event_id % 211 = 0",
    "lots": "SELECT o_custkey AS portfolio_id, p_brand AS symbol, l_quantity AS shares, l_extendedprice / l_quantity AS avg_cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
    "calls": "SELECT 'p' || (user_id % 3) AS provider, ts AS call_timestamp, event_type <> 'error' AS success, CAST(floor(value) AS bigint) AS latency_ms, CASE WHEN event_type = 'error' THEN 'timeout' END AS failure_type FROM events",
    "listing": "SELECT 'P' || p_partkey || '.NS' AS symbol, p_name AS name, p_brand AS series FROM part",
    "news": "SELECT doc_id, text AS headline, DATE '2024-01-01' + CAST(doc_id % 30 AS int) AS d, 'Brand#' || (doc_id % 25 + 1) AS symbol FROM documents",
}


def using(*names: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names) + " "
