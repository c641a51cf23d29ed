"""Lookups: instruments, free text to symbols, watchlists, ids by two hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_supported, normalize_query

#: Words of a question that name no company. A fixed value.
STOPWORDS = ("a", "an", "and", "are", "best", "buy", "compare", "does", "for", "how", "i", "in", "is", "it", "me", "my", "of", "or", "should", "tell", "the", "to", "top", "vs", "versus", "what", "which", "why", "with")


def instrument(instruments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (symbol, segment) with the instrument that fits best: exact trading symbol, then exact name, then a symbol that starts so."""
    w = F.upper("wanted_symbol")
    rank = F.when(F.upper("trading_symbol") == w, 1).when(F.upper("name") == w, 2).when(F.upper("trading_symbol").startswith(w), 3)
    pairs = instruments.join(F.broadcast(wanted.withColumnRenamed("symbol", "wanted_symbol")), "segment").withColumn("rank", rank).where("rank is not null")
    by = Window.partitionBy("wanted_symbol", "segment").orderBy("rank", F.length("trading_symbol"), "token")
    return pairs.withColumn("n", F.row_number().over(by)).where("n = 1").select("wanted_symbol", "segment", "token", "trading_symbol", "rank")


def backfill_ids(prices: DataFrame, tickers: DataFrame, registry: DataFrame) -> DataFrame:
    """prices with internal_id where it is NULL, by ticker id, then current symbol; others stay as they are."""
    ids = tickers.select("ticker_id", "symbol").join(registry.select(F.col("current_symbol").alias("symbol"), F.col("internal_id").alias("_id")), "symbol").select("ticker_id", "_id")
    return prices.join(ids, "ticker_id", "left").withColumn("internal_id", F.coalesce("internal_id", "_id")).drop("_id")


def watchlist(entries: DataFrame, tickers: DataFrame) -> DataFrame:
    return entries.join(tickers, "ticker_id").orderBy("added_at", "symbol").select("symbol", "name", "added_at")


def grams(c: Column, n: int) -> Column:
    """The distinct runs of n characters of c; of a shorter text, the text."""
    c = F.coalesce(c, F.lit(""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))


def matches(asked: DataFrame, index: DataFrame, n: int = 3) -> DataFrame:
    """Pairs of asked (column q, normalised and not empty) and index rows that some tier fits, with column tier.

    Every tier means that q, or q without blanks, is part of a listing's name or ticker. So pairs are found by equi-joins: the
    first n characters of q with the runs of n characters of names and tickers, and whole queries shorter than n with
    their runs of as many. No side is broadcast, and no query meets a listing without a common run.
    """
    from .search import tier

    squeezed = F.replace(F.col("q"), F.lit(" "), F.lit(""))
    out = None
    for k in range(1, n + 1):
        mine = asked.where(F.length(squeezed) == k if k < n else F.length(squeezed) >= n)
        keyed = mine.select("*", F.explode(F.array_distinct(F.array(F.substr("q", F.lit(1), F.lit(k)), F.substr(squeezed, F.lit(1), F.lit(k))))).alias("_g"))
        runs = F.array_union(grams(F.col("clean"), k), grams(F.col("bare"), k))
        part = keyed.join(index.select("*", F.explode(runs).alias("_g")), "_g").drop("_g").withColumn("tier", tier(F.col("q"))).where("tier is not null")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def resolve_text(texts: DataFrame, index: DataFrame) -> DataFrame:
    """text and symbol: a supported symbol as it is, else an exact bare ticker, else the first by search order."""
    asked = texts.select("text", F.upper(F.trim("text")).alias("u"), normalize_query(F.col("text")).alias("q")).distinct()
    plain = asked.where(is_supported(F.col("u"))).select("text", F.col("u").alias("symbol"))
    rest = asked.where(~is_supported(F.col("u")) & (F.col("q") != ""))
    hits = matches(rest, index).groupBy("text").agg(F.min(F.struct("tier", "name", "symbol")).alias("best"))
    return asked.select("text").join(plain.unionByName(hits.select("text", "best.symbol")), "text", "left")


def phrases(question: Column, longest: int = 3) -> Column:
    """Runs of 3, 2 and 1 words without a stop word: array<struct<at, n, phrase>>, longest first, then by place."""
    words = F.filter(F.split(F.lower(F.regexp_replace(question, r"[^A-Za-z0-9&. ]", " ")), r"\s+"), lambda w: w != "")

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        every = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.slice(words, i, n).alias("w")))
        return F.filter(every, lambda x: (F.size(x["w"]) == n) & ~F.arrays_overlap(x["w"], F.array(*(F.lit(s) for s in STOPWORDS))))

    parts = [runs(n) for n in range(longest, 0, -1)]
    return F.transform(F.concat(*parts), lambda x: F.struct(x["at"], x["n"], F.array_join(x["w"], " ").alias("phrase")))


def extract_symbols(questions: DataFrame, index: DataFrame, most: int = 3) -> DataFrame:
    """question, symbols: phrases that name a listing exactly by ticker or by name, not overlapping, longer ones first, `most` at most."""
    p = questions.select("question", F.posexplode(phrases(F.col("question"))).alias("k", "p")).select("question", "k", "p.*").withColumn("q", normalize_query(F.col("phrase")))
    names = index.select(F.col("bare").alias("q"), "symbol").unionByName(index.select(F.col("clean").alias("q"), "symbol")).groupBy("q").agg(F.min("symbol").alias("symbol"))
    found = p.join(names, "q").groupBy("question").agg(F.array_sort(F.collect_list(F.struct("k", "at", "n", "symbol"))).alias("h"))
    # a question has a few dozen phrases: a fold over them keeps those that touch none kept before
    kept = F.aggregate("h", F.array().cast("array<struct<k:int,at:int,n:int,symbol:string>>"), lambda a, x: F.when((F.size(a) < most) & ~F.exists(a, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])) & ~F.exists(a, lambda y: y["symbol"] == x["symbol"]), F.array_append(a, x)).otherwise(a))
    return questions.select("question").join(found.select("question", F.transform(kept, lambda x: x["symbol"]).alias("symbols")), "question", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
