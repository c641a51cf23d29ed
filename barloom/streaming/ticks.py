"""Ticks: outcome by sequence or time, last-value merge, and bars from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import guard

OUTCOME = [T.StructField("outcome", T.StringType()), T.StructField("gap", T.LongType())]


def classify(ticks: DataFrame) -> DataFrame:
    """Batch twin of the stream: each symbol's ticks in order of arrival through one guard. The outcome of a tick depends on
    all before it, so a symbol is one ordered pass; rows stream through it, and no symbol is held whole."""
    schema = T.StructType([*ticks.schema.fields, *OUTCOME])
    return ticks.repartition("symbol").sortWithinPartitions("symbol", "arrival").mapInArrow(guard.label, schema)


def classify_by_time(ticks: DataFrame) -> DataFrame:
    """The same without sequence ids, as from a feed that has none: seen among the last times, later than all before, or out of order."""
    told = classify(ticks.select("*", F.col("sequence_id").alias("_id")).withColumn("sequence_id", F.lit(None).cast(ticks.schema["sequence_id"].dataType)))
    return told.withColumn("sequence_id", F.col("_id")).drop("_id", "gap")


def classify_stream(ticks: DataFrame) -> DataFrame:
    """A stream of (symbol, ltp, exchange_ts, sequence_id, arrival) with outcome and gap; sequence ids may be missing.
    State per symbol: high-water mark, last time, last ids and times."""
    from pyspark.sql.streaming import StatefulProcessor

    # ids and times as text: pandas has no missing integers
    rows = ticks.withColumns({"at_text": F.unix_micros(F.col("exchange_ts").cast("timestamp")).cast("string"), "id_text": F.col("sequence_id").cast("string")})
    schema = T.StructType([*rows.schema.fields, *OUTCOME])

    class Processor(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("guard", "seq long, ts long, ids array<long>, times array<long>")

        def handleInputRows(self, key, rows, timerValues):
            g = guard.Guard(*(self.state.get() if self.state.exists() else ()))
            for pdf in rows:
                pdf = pdf.sort_values("arrival", ignore_index=True)
                got = [g.evaluate(*(int(x) if isinstance(x, str) else None for x in row)) for row in zip(pdf["at_text"], pdf["id_text"])]
                yield pdf.assign(outcome=[o for o, _ in got], gap=[n for _, n in got])
            self.state.update((g.last_seq, g.last_ts, list(g.ids.order), list(g.times.order)))

        def close(self):
            pass

    told = rows.drop("sequence_id").groupBy("symbol").transformWithStateInPandas(Processor(), T.StructType([f for f in schema.fields if f.name != "sequence_id"]), "Append", "None")
    return told.withColumn("sequence_id", F.col("id_text").cast("long")).select(*ticks.columns, "outcome", "gap")


def accepted(classified: DataFrame) -> DataFrame:
    """What reaches the last-value cache: ACCEPT and GAP, and ticks without a time."""
    return classified.where(F.col("outcome").isin(guard.ACCEPT, guard.GAP) | F.col("exchange_ts").isNull())


def merge_latest(ticks: DataFrame, *fields: str, order: str = "arrival") -> DataFrame:
    """Per symbol, each field's last value that isn't NULL: one partial aggregate, no sort."""
    return ticks.groupBy("symbol").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def epoch_ms(c: Column) -> Column:
    """A timestamp from epoch milliseconds as text; NULL where it is none."""
    return F.timestamp_millis(c.try_cast("bigint"))


def minute_bars(ticks: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Bars of a stream or a table of ticks; rows later than `late` are dropped from a stream (an extension)."""
    df = ticks.withWatermark("exchange_ts", late) if ticks.isStreaming else ticks
    at = F.struct("exchange_ts", "sequence_id")
    out = df.groupBy("symbol", F.window("exchange_ts", width).alias("w")).agg(F.min_by("ltp", at).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", at).alias("close"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "ticks")


def live_change(ticks: DataFrame, closes: DataFrame) -> DataFrame:
    """Newest tick of each symbol against a reference close."""
    return merge_latest(ticks, "ltp").join(closes.select("symbol", "close"), "symbol", "left").withColumn("change", F.try_divide(F.col("ltp"), F.col("close")) - 1)
