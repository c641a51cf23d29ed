"""Portfolios, their lots, and watchlists: changes as new versions of tables, for many changes at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered
from .store import upsert


def valid(shares: Column, avg_cost: Column) -> Column:
    """Finite numbers, shares above 0, cost not below 0."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(finite(shares) & finite(avg_cost) & (shares > 0) & (avg_cost >= 0), F.lit(False))


def _numbered(new: DataFrame, have: DataFrame, *order: str) -> DataFrame:
    """new with ids after the largest that have has, in order."""
    top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = numbered(new, list(order), "_n")
    return rows.join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast("long")).drop("_top", "_n")


def create(portfolios: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """portfolios (id, name) with those of new (name and the columns of order) whose trimmed name, in any case, is not taken: the first of a batch takes it."""
    key = F.lower(F.trim("name"))
    fresh = new.withColumns({"name": F.trim("name"), "_k": key}).where("_k <> ''")
    fresh = fresh.join(portfolios.select(key.alias("_k")), "_k", "left_anti")
    first = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_r", "_k")
    return portfolios.select("id", "name").unionByName(_numbered(first, portfolios, *order).select("id", "name"))


def add(lots: DataFrame, new: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(lots with the valid ones of new as further lots, those refused). A second buy of a symbol is a lot of its own; symbols are upper case."""
    good = valid(F.col("shares"), F.col("avg_cost"))
    rows = new.withColumn("symbol", F.upper(F.trim("symbol")))
    return lots.unionByName(_numbered(rows.where(good), lots, *order).select(lots.columns)), rows.where(~good)


def update(lots: DataFrame, changes: DataFrame) -> DataFrame:
    """lots with new shares and cost by id; invalid changes and unknown ids change nothing. One change an id."""
    good = changes.where(valid(F.col("shares"), F.col("avg_cost"))).select("id", F.col("shares").alias("_s"), F.col("avg_cost").alias("_c"))
    out = lots.join(good, "id", "left")
    return out.withColumns({"shares": F.coalesce("_s", "shares"), "avg_cost": F.coalesce("_c", "avg_cost")}).select(lots.columns)


def delete(lots: DataFrame, gone: DataFrame) -> DataFrame:
    """lots without those of the ids of gone."""
    return lots.join(gone.select("id"), "id", "left_anti")


def touched(portfolios: DataFrame, before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """portfolios (id, updated_at) with updated_at now where a lot came, went or changed."""
    changed = before.exceptAll(after).unionByName(after.exceptAll(before)).select(F.col("portfolio_id").alias("id")).distinct().withColumn("_now", now)
    return portfolios.join(changed, "id", "left").withColumn("updated_at", F.coalesce("_now", "updated_at")).drop("_now")


def watch(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """entries (ticker_id, added_at) with those of wanted that aren't there, the earliest of each."""
    new = wanted.groupBy("ticker_id").agg(F.min("added_at").alias("added_at")).join(entries.select("ticker_id"), "ticker_id", "left_anti")
    return entries.unionByName(new)


def unwatch(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("ticker_id"), "ticker_id", "left_anti")


def seeded(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """entries, or defaults if there is none: what a user removed doesn't come back."""
    empty = entries.limit(1).agg((F.count("*") == 0).alias("_empty"))
    return entries.unionByName(defaults.join(F.broadcast(empty), F.col("_empty")).drop("_empty"))


def backfill(universe: DataFrame, done: DataFrame, source: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored with the bars of those symbols of universe that the checkpoint `done` lacks, the checkpoint's new rows: symbol, status, n).

    A symbol whose source has no bars is `failed`, and so is tried again next time. Bars replace stored ones of the same symbol and date.
    """
    todo = universe.join(done.where("status = 'completed'").select("symbol"), "symbol", "left_anti")
    bars = source.join(todo.select("symbol"), "symbol", "left_semi")
    got = todo.select("symbol").join(bars.groupBy("symbol").agg(F.count("*").alias("n")), "symbol", "left")
    log = got.select("symbol", F.when(F.col("n") > 0, "completed").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    return upsert(stored, bars, "symbol", "d"), log
