"""Stored tables: bars by symbol and year, feature sets, manifests, reference lists and holdings as CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("d", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType())])


def shared(spark: SparkSession, name: str) -> str:
    """A new path that all executors share: under spark.checkpoint.dir; a local folder where none is set, in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/barloom-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/barloom/{name}-{uuid.uuid4().hex}"


def write_bars(bars: DataFrame, path: str) -> None:
    """Rewrites the partitions that bars has, by symbol and year, and leaves others; one file for each."""
    out = bars.withColumn("year", F.year("d")).repartition("symbol", "year")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One symbol's bars between two dates, by date; partitions of other symbols and years aren't listed."""
    df = spark.read.schema(T.StructType([*BARS.fields, T.StructField("year", T.IntegerType())])).parquet(path).where(F.upper("symbol") == symbol.upper())
    # stored symbols are upper case; the fixture's are matched without case
    if start:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col("d") >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col("d") <= F.lit(end).cast("date")))
    return df.drop("year").orderBy("d")


def write_features(features: DataFrame, path: str, version: str, existing: DataFrame | None = None) -> None:
    """Append rows of a feature version that aren't stored yet, features as one JSON text."""
    names = [c for c in features.columns if c not in ("symbol", "d", "label")]
    rows = features.select(F.lit(version).alias("version"), "symbol", "d", F.to_json(F.struct(*names)).alias("features"), "label")
    if existing is not None:
        rows = rows.join(existing.select("version", "symbol", "d"), ["version", "symbol", "d"], "left_anti")
    rows.write.mode("append").partitionBy("version").parquet(path)


def read_features(spark: SparkSession, path: str, version: str, names: list[str]) -> DataFrame:
    """symbol, d, features and label of a version, rows without a label left out, ordered."""
    df = spark.read.parquet(path).where((F.col("version") == version) & F.col("label").isNotNull())
    parsed = F.from_json("features", T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    return df.select("symbol", "d", parsed.alias("f"), F.col("label").cast("int").alias("label")).select("symbol", "d", "f.*", "label").orderBy("symbol", "d")


def manifest(bars: DataFrame, version: str) -> DataFrame:
    """One JSON text that describes a dataset, with a SHA-256 over its content."""
    row = bars.agg(F.count("*").alias("row_count"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.min("d").alias("start_date"), F.max("d").alias("end_date")).withColumn("version", F.lit(version))
    body = F.to_json(F.struct("end_date", "row_count", "start_date", "symbols", "version"))
    return row.select(body.alias("value"), F.sha2(body, 256).alias("checksum"))


def read_universe(spark: SparkSession, path: str, suffix: str = ".NS", benchmarks: tuple[str, ...] = ()) -> DataFrame:
    """symbol, name, series of a CSV list: blanks stripped from headers and values, suffix appended, one row for each symbol, benchmarks first."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in raw.columns))
    df = df.select(F.concat("symbol", F.lit(suffix)).alias("symbol"), "name", "series").groupBy("symbol").agg(F.min_by("name", F.struct("name", "series")).alias("name"), F.min_by("series", F.struct("name", "series")).alias("series"))
    if benchmarks:
        head = spark.createDataFrame([(b, b, "INDEX") for b in benchmarks], "symbol string, name string, series string")
        df = head.unionByName(df.join(head.select("symbol"), "symbol", "left_anti"))
    return df


def valid_holdings(df: DataFrame, shares: str = "shares", cost: str = "cost") -> DataFrame:
    """Finite positive shares and a finite cost of 0 or more."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return df.where(finite(shares) & finite(cost) & (F.col(shares) > 0) & (F.col(cost) >= 0))


def read_holdings(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped) of a holdings CSV: headers without case, unknown symbols and shares that are no positive number skipped, a missing cost 0."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(*(F.trim(F.col(f"`{c}`")).alias(c.strip().lower()) for c in raw.columns))
    df = df.select(F.upper("symbol").alias("symbol"), F.col("shares").try_cast("double").alias("shares"), F.coalesce(F.col("avg_cost").try_cast("double"), F.lit(0.0)).alias("cost"))
    df = df.join(known.select("symbol").distinct().withColumn("_known", F.lit(True)), "symbol", "left")
    good = F.coalesce("_known", F.lit(False)) & F.coalesce(F.col("shares") > 0, F.lit(False)) & ~F.isnan(F.coalesce("shares", F.lit(0.0)))
    return df.where(good).drop("_known"), df.where(~good).drop("_known")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def with_retry(call, attempts: int = 3, wait: float = 1.0):
    """The call's result; after an OSError it is tried again, waiting longer each time."""
    import time

    for k in range(1, attempts + 1):
        try:
            return call()
        except OSError:
            if k == attempts:
                raise
            time.sleep(wait * k)
