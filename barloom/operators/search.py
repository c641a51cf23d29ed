"""Ranked search over listings: derived columns once, a tier for each row, a five-key top k. Fuzzy scores only where no tier fits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions.text import clean_name, matches_exchange, normalize_query, without_suffix

LABELS = ("exact_ticker", "exact_name", "name_starts_with", "ticker_starts_with", "name_word_prefix", "name_contains", "ticker_contains", "fuzzy")
FUZZY_LEAST, GUESS = 65.0, 6


def prepare(listing: DataFrame, extra: DataFrame | None = None, defaults: tuple[str, ...] = ()) -> DataFrame:
    """The index: listings, and extra ones whose symbol isn't listed, with derived columns. Cache it to serve many searches."""
    if extra is not None:
        listing = listing.unionByName(extra.join(listing.select("symbol"), "symbol", "left_anti"), allowMissingColumns=True)
    clean = normalize_query(clean_name(F.col("name")))
    return listing.withColumns({"bare": F.replace(normalize_query(without_suffix(F.col("symbol"))), F.lit(" "), F.lit("")), "clean": clean, "tokens": F.split(clean, " "), "is_default": F.col("symbol").isin(*defaults) if defaults else F.lit(False)})


def health(index: DataFrame) -> DataFrame:
    """One row: listings, distinct names, listings without a name, of each exchange, and tickers that stand for several."""
    return index.agg(
        F.count("*").alias("symbols"), F.count_distinct("clean").alias("names"), F.count_if(F.coalesce(F.col("clean"), F.lit("")) == "").alias("nameless"), F.count_if(F.col("symbol").endswith(".NS")).alias("nse"),
        F.count_if(F.col("symbol").endswith(".BO")).alias("bse"), (F.count("bare") - F.count_distinct("bare")).alias("shared_tickers"),
    )


def tier(query: Column) -> Column:
    """Number of the first rule that fits, by the column of normalised queries; NULL if none does."""
    q = F.replace(query, F.lit(" "), F.lit(""))
    rules = (F.col("bare") == q, F.col("clean") == query, F.col("clean").startswith(query), F.col("bare").startswith(q), F.exists("tokens", lambda t: t.startswith(query)), F.col("clean").contains(query), F.col("bare").contains(q))
    out = F.when(rules[0], 1)
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule, i)
    return out


def boost(recent=(), watchlist=(), held=()) -> Column:
    part = lambda xs, v: F.when(F.col("symbol").isin(*xs), v).otherwise(0.0) if xs else F.lit(0.0)
    return part(recent, 0.3) + part(watchlist, 0.5) + part(held, 0.5)


def search(index: DataFrame, text: str, limit: int = 10, exchange: str | None = None, context: dict | None = None) -> DataFrame:
    """symbol, name, tier, score, the best `limit`; ties by name, then symbol."""
    spark = index.sparkSession
    query = normalize_query(F.lit(text))
    plain = spark.range(1).select(query.alias("q")).first()["q"]
    rows = index.where(matches_exchange(F.col("symbol"), exchange)).withColumn("tier", tier(F.lit(plain)))
    if not plain:
        rows = rows.where("false")
    # rows without a tier go after the limit: a filter before it would be pushed below the derived columns, which would be made anew for each rule
    none = F.col("tier").isNull()
    if plain.isalpha() and " " not in plain and len(plain) <= GUESS:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = rows.withColumn("score", F.coalesce(fuzzy_score(F.when(none, F.col("clean")), plain), F.lit(0.0))).withColumn("tier", F.when(none & (F.col("score") >= FUZZY_LEAST), 8).otherwise(F.col("tier")))
    context = context or {}
    rows = rows.withColumn("boost", boost(context.get("recent", ()), context.get("watchlist", ()), context.get("held", ())))
    best = rows.orderBy(F.asc_nulls_last("tier"), F.desc("boost"), F.desc("score"), F.desc("is_default"), "name", "symbol").limit(limit)
    return best.where("tier is not null").select("symbol", "name", "tier", "score")


def fuzzy_score(name: Column, query: str) -> Column:
    """NULL for no name. A name that many rows of a batch have is scored once."""
    words = query.split()

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map({n: fuzzy.token_score(words, n.split()) for n in s.dropna().unique()}).astype(float)

    return run(name)


def matched(query: Column, symbol: Column, name: Column, tier_: Column) -> Column:
    """The part of symbol or name that the query fits, whatever marks stand between."""
    any_ = F.lit("[^A-Za-z0-9]*")
    bare = F.concat(F.lit("(?i)("), F.array_join(F.split(F.replace(query, F.lit(" "), F.lit("")), ""), "[^A-Za-z0-9]*"), F.lit(")"))
    words = F.concat(F.lit("(?i)("), F.replace(query, F.lit(" "), any_), F.lit(")"))
    by_symbol = F.when(tier_.isin(1, 4, 7), F.nullif(F.regexp_substr(symbol, bare), F.lit("")))
    return F.when(tier_ < 8, F.coalesce(by_symbol, F.regexp_substr(name, words)))


#: Letters, rare ones first; others, digits for one, come before them all.
RARE = "qzjxkvbywgpfmucdlhrsnioate"
#: Least share of the letters of two words, taken together, that must be in their common subsequence (twice) for FUZZY_LEAST.
_SHARE = FUZZY_LEAST / 200


def _tokens(word: Column) -> Column:
    """The letters of a word, each with the number of its occurrence, rare letters first: two words share as many as their common multiset has."""
    chars = F.split(word, "")
    numbered_ = F.transform(chars, lambda c, i: F.struct(F.instr(F.lit(RARE), F.lower(c)).alias("o"), c.alias("c"), F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).alias("n")))
    return F.transform(F.array_sort(numbered_), lambda t: F.concat(t["c"], t["n"].cast("string")))


def alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """(q, n): pairs of words of left (q) and right (n), both distinct, that may reach FUZZY_LEAST; none that does is missing.

    A common subsequence of k letters means k letters in common, as multisets. So among the words' letters in one order (rare ones first),
    the first |q| - k + 1 of one and the first |n| - k + 1 of the other have one in common. These are joined by both lengths and letter.
    """
    longest = F.lit((1 - _SHARE) / _SHARE)  # neither word is more times longer: its common letters are the shorter one's at most

    def keyed(df: DataFrame, c: str, own: str, other: str) -> DataFrame:
        size = F.length(c)
        df = df.where(size > 0).select(c, size.alias(own), F.explode(F.sequence(F.ceil(size / longest).cast("int"), F.floor(size * longest).cast("int"))).alias(other))
        k = F.ceil(F.lit(_SHARE) * (F.col(own) + F.col(other)) - 1e-9)
        df = df.where((k <= F.col(own)) & (k <= F.col(other)))
        return df.select(c, own, other, F.explode(F.slice(_tokens(F.col(c)), F.lit(1), (F.col(own) - k + 1).cast("int"))).alias("t"))

    return keyed(left, "q", "lq", "ln").join(keyed(right, "n", "ln", "lq"), ["lq", "ln", "t"]).select("q", "n").distinct()


def fuzzy_many(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, q, clean, score) of all names that score FUZZY_LEAST or more for queries (asked, q).

    A score is the mean of each query word's best ratio, so some word reaches FUZZY_LEAST with a word of the name: names with such a word are scored, others can't be hits.
    """
    queries = asked.where("q <> ''").select("asked", "q", F.explode(F.split("q", " ")).alias("w"))
    names = index.select("clean").where("clean <> ''").distinct()
    words = names.select("clean", F.explode(F.array_distinct(F.split("clean", " "))).alias("n"))
    pairs = alike(queries.select(F.col("w").alias("q")).distinct(), words.select("n").distinct())

    @F.pandas_udf("double")
    def ratios(q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.ratio(a, b) for a, b in zip(q, n)], dtype=float)

    @F.pandas_udf("double")
    def scores(q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([fuzzy.token_score(a.split(), b.split()) for a, b in zip(q, n)], dtype=float)

    near = pairs.where(ratios("q", "n") >= FUZZY_LEAST).withColumnRenamed("q", "w")
    candidates = queries.join(near, "w").join(words, "n").select("asked", "q", "clean").distinct()
    return candidates.withColumn("score", scores("q", "clean")).where(F.col("score") >= FUZZY_LEAST)


def search_many(index: DataFrame, queries: DataFrame, limit: int = 5, fuzzy_too: bool = False) -> DataFrame:
    """The best rows for each of many queries (column q): tiers 1 to 7, and with fuzzy_too tier 8, by score, for names that no tier fits. A table of queries of any size: see `lookup.matches`."""
    from pyspark.sql import Window

    from .lookup import matches

    asked = queries.select(F.col("q").alias("asked"), normalize_query(F.col("q")).alias("q")).distinct().where("q <> ''")
    rows = matches(asked, index).withColumn("score", F.lit(0.0))
    if fuzzy_too:
        guess = F.col("q").rlike("^[A-Za-z]+$") & (F.length("q") <= GUESS)
        found = fuzzy_many(index, asked.where(~guess)).join(index, "clean").join(rows.select("asked", "symbol"), ["asked", "symbol"], "left_anti").withColumn("tier", F.lit(8))
        rows = rows.unionByName(found.select(rows.columns))
    w = Window.partitionBy("asked").orderBy("tier", F.desc("score"), "name", "symbol")
    return rows.withColumn("rank", F.row_number().over(w)).where(f"rank <= {limit}")
