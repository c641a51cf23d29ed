"""Inserts, upserts and other changes as new versions of immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new's rows, and old's where new has no row of the key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, *keys: str, order: list[Column] | None = None) -> DataFrame:
    """The rows of new to append: keys that old lacks, the first row of each key in the batch."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(k) for k in keys]))
    return new.join(old.select(*keys), list(keys), "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_bars(old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Bars to append: no NULL in prices or volume, dates that the symbol lacks, the first of a batch; a dividend or split of 0 is NULL."""
    for c in ("dividend", "split_ratio"):
        if c in new.columns:
            new = new.withColumn(c, F.nullif(F.col(c), F.lit(0.0)))
    return insert_ignore(old, new.na.drop(subset=["open", "high", "low", "close", "volume"]), "symbol", "d", order=order)


def numbered(new: DataFrame, have: int | Column, *order: str) -> DataFrame:
    """With internal ids FIN-0001 and on, after the `have` that exist."""
    out = ordered.numbered(new, list(order), "|n")
    return out.withColumn("internal_id", F.format_string("FIN-%04d", F.col("`|n`") + F.lit(have))).drop("|n")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def remaining(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return every.select(key).join(done.select(key), key, "left_anti")


def remove(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the keys to remove."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def rename(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (internal_id, new_symbol, effective_date, reason): the old name joins the history arrays. One change per id in a call."""
    df = registry.join(changes, "internal_id", "left")
    hit = F.col("new_symbol").isNotNull()
    entry = F.struct(F.col("current_symbol").alias("old_symbol"), F.col("new_symbol"), F.col("effective_date"), F.col("reason"))
    return df.select(
        "internal_id", F.coalesce("new_symbol", "current_symbol").alias("current_symbol"), F.when(hit, F.array_append("historical_symbols", F.col("current_symbol"))).otherwise(F.col("historical_symbols")).alias("historical_symbols"),
        F.when(hit, F.array_append("rename_history", entry)).otherwise(F.col("rename_history")).alias("rename_history"), "merger_history",
    )


def merge(registry: DataFrame, mergers: DataFrame) -> DataFrame:
    """mergers (internal_id, counterpart, transaction_type, effective_date) appended to merger_history of their side."""
    entry = F.struct("counterpart", "transaction_type", "effective_date")
    df = registry.join(mergers, "internal_id", "left")
    return df.withColumn("merger_history", F.when(F.col("counterpart").isNotNull(), F.array_append("merger_history", entry)).otherwise(F.col("merger_history"))).select(*registry.columns)


def resolve(registry: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, internal_id, n: by current name first, else by former names; n over 1 is a conflict to report."""
    now = registry.select(F.col("current_symbol").alias("symbol"), "internal_id", F.lit(0).alias("rank"))
    past = registry.select(F.explode("historical_symbols").alias("symbol"), "internal_id", F.lit(1).alias("rank"))
    found = symbols.join(now.unionByName(past), "symbol", "left")
    first = found.withColumn("best", F.min("rank").over(Window.partitionBy("symbol"))).where("rank <=> best")
    return first.groupBy("symbol").agg(F.min("internal_id").alias("internal_id"), F.count("internal_id").alias("n"))


def activate(registry: DataFrame) -> DataFrame:
    """One active version of each model: the newest."""
    return registry.withColumn("is_active", F.col("version") == F.max_by("version", "id").over(Window.partitionBy("model_name")))


# ---- progress of resumable work: rows (stage, internal_id, status, reason, at)


def enter_stage(progress: DataFrame, stage: str) -> DataFrame:
    """progress of a stage that is entered: what was there of it stays, that of other stages goes."""
    return progress.where(F.col("stage") == stage)


def mark_completed(progress: DataFrame, units: DataFrame, stage: str) -> DataFrame:
    """progress with units (internal_id, at) as completed: each once, however often it is marked; a later date replaces an earlier one."""
    new = units.groupBy("internal_id").agg(F.max("at").alias("at")).select(F.lit(stage).alias("stage"), "internal_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"), "at")
    return upsert(progress, new, "stage", "internal_id", "status")


def mark_failed(progress: DataFrame, units: DataFrame, stage: str) -> DataFrame:
    """progress with units (internal_id, reason, at) as failed: each failure is a row of its own."""
    return progress.unionByName(units.select(F.lit(stage).alias("stage"), "internal_id", F.lit("failed").alias("status"), "reason", "at"))


# ---- registries of features and models

FEATURE_STATUSES, MODEL_STATUSES = ("active", "deprecated"), ("active", "testing", "archived")


def set_features(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """registry (feature_name, status, reason, evidence) after changes of the same columns, one of a name: features it lacks are
    added. A deprecation brings its reason and evidence; a confirmation as active keeps the reason, and the evidence unless it brings some."""
    new = changes.where(F.col("status").isin(*FEATURE_STATUSES)).select("feature_name", *(F.col(c).alias(f"_{c}") for c in ("status", "reason", "evidence")))
    gone = F.col("_status") == "deprecated"
    return registry.join(new, "feature_name", "full").select(
        "feature_name", F.coalesce("_status", "status").alias("status"), F.when(gone, F.col("_reason")).otherwise(F.col("reason")).alias("reason"), F.when(gone, F.col("_evidence")).otherwise(F.coalesce("_evidence", "evidence")).alias("evidence")
    )


def set_model_status(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the status of versions changed, changes refused: unknown versions and statuses). Which version is served doesn't change."""
    known = F.col("status").isin(*MODEL_STATUSES)
    good = changes.where(known).join(registry.select("version"), "version", "left_semi").select("version", F.col("status").alias("_status"))
    refused = changes.where(~F.coalesce(known, F.lit(False))).unionByName(changes.where(known).join(registry.select("version"), "version", "left_anti"))
    return registry.join(good, "version", "left").withColumn("status", F.coalesce("_status", "status")).select(registry.columns), refused
