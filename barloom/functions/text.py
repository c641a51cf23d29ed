"""Text scalars: query normalising, names, sentiment, intents, failures, exchanges, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and names that results depend on.
CORPORATE = r"(?i)\b(limited|ltd|company|corporation|corp)\b\.?"
PORTFOLIO = ("portfolio", "my holdings", "my holding", "my stocks", "my investments")
MARKET = ("market", "nifty", "sensex", "bank nifty", "index", "indices")
INDICATOR = ("rsi", "macd", "atr", "adx", "vwap", "bollinger", "sharpe", "drawdown", "support", "resistance", "volatility")
RECOMMENDATION = ("best", "top", "which stock", "recommend", "should i buy")
SECTORS = {
    "it": "Technology", "tech": "Technology", "technology": "Technology", "bank": "Financial Services", "banking": "Financial Services", "financial": "Financial Services", "pharma": "Healthcare",
    "pharmaceutical": "Healthcare", "healthcare": "Healthcare", "auto": "Consumer Cyclical", "automobile": "Consumer Cyclical", "energy": "Energy", "oil": "Energy", "fmcg": "Consumer Defensive",
}


def without_suffix(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.NS$", ""), r"\.BO$", "")


def normalize_query(c: Column) -> Column:
    """Upper case, without exchange suffix, `&`, `-` and `.` as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_suffix(F.upper(F.trim(c))), r"[&\-.]", " "), r"\s+", " "))


def clean_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, CORPORATE, ""), r"\s+", " "))


def exchange(symbol: Column) -> Column:
    return F.when(symbol.endswith(".NS"), "NSE").when(symbol.endswith(".BO"), "BSE")


def matches_exchange(symbol: Column, wanted: str | None) -> Column:
    suffix = {"NSE": ".NS", "BSE": ".BO"}.get((wanted or "").upper())
    return symbol.endswith(suffix) if suffix else F.lit(True)


def is_supported(symbol: Column, indices: tuple[str, ...] = ("^NSEI", "^BSESN", "^NSEBANK")) -> Column:
    return symbol.rlike(r"\.(NS|BO)$") | symbol.isin(*indices)


def failure_type(text: Column, error: Column | None = None) -> Column:
    """Class of a failed fetch by its message and, if given, the name of its error; what came back in a wrong form is `malformed_response`."""
    t, name = F.lower(text), F.coalesce(error, F.lit("")) if error is not None else F.lit("")
    has = lambda *x: t.rlike("|".join(x))
    return F.when(name == "MalformedResponse", "malformed_response").when(has("timeout") | F.lower(name).contains("timed out"), "timeout").when(has("429", "rate limit", "too many requests"), "rate_limit").when(has("401", "403", "auth"), "auth").when(has("not found", "404"), "not_found").otherwise("connection_error")


def sentiment(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> tuple[Column, Column]:
    """(score, confidence) by words of two lists; 0 and 0.2 without any."""
    # a word is a run of letters and apostrophes; counting listed ones needs no list of all
    count = lambda x: F.regexp_count(F.lower(text), F.lit("(?<![a-z'])(?:" + "|".join(x) + ")(?![a-z'])")) if x else F.lit(0)
    p, n = count(positive), count(negative)
    hits = p + n
    return F.when(hits == 0, 0.0).otherwise(F.bround((p - n) / F.nullif(hits, F.lit(0)), 2)), F.when(hits == 0, 0.2).otherwise(F.bround(F.least(0.3 + 0.1 * hits, F.lit(0.7)), 2))


def sentiment_label(score: Column, cut: float = 0.1) -> Column:
    return F.when(score > cut, "Positive").when(score < -cut, "Negative").when(score.isNotNull(), "Neutral")


def _any(text: Column, terms) -> Column:
    return text.rlike(r"\b(" + "|".join(terms) + r")\b")


def sector_of(question: Column) -> Column:
    q, out = F.lower(question), None
    for k, v in SECTORS.items():
        out = F.when(_any(q, [k]), v) if out is None else out.when(_any(q, [k]), v)
    return out


def intent(question: Column, n_symbols: Column) -> Column:
    q, none = F.lower(question), n_symbols == 0
    return (
        F.when(_any(q, PORTFOLIO), "portfolio").when(none & _any(q, RECOMMENDATION) & sector_of(question).isNotNull(), "sector_recommendation").when(n_symbols >= 2, "comparison").when(none & _any(q, INDICATOR), "indicator")
        .when(none & _any(q, MARKET), "market").when(n_symbols > 0, "single_stock").otherwise("general")
    )


def format_inr(value: Column, decimals: int = 2) -> Column:
    """Rupees with the last three digits, then pairs; a dash for NULL."""
    shown = F.format_string(f"%.{decimals}f", F.abs(value))
    whole = F.floor(F.abs(value)).cast("string")
    head = F.reverse(F.regexp_replace(F.reverse(F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))), r"(\d{2})(?=\d)", "$1,"))
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    frac = F.concat(F.lit("."), F.substring_index(shown, ".", -1)) if decimals else F.lit("")
    return F.when(value.isNull(), "—").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), F.lit("₹"), grouped, frac))


def direction_word(pct: Column) -> Column:
    return F.when(pct >= 0, "up").otherwise("down")


def market_summary(nifty: Column, top_symbol: Column, top_pct: Column, low_symbol: Column, low_pct: Column, sensex: Column | None = None, bank: Column | None = None) -> Column:
    """One sentence on those indices that have a change, one on the movers that there are."""
    show = lambda x: F.format_string("%.1f%%", F.abs(x) * 100)
    clause = lambda name, x, tail="": F.when(x.isNotNull(), F.concat(F.lit(f"{name} is "), direction_word(x), F.lit(" "), show(x), F.lit(tail)))
    clauses = [clause("Nifty 50", nifty, " today"), *(clause(n, x) for n, x in (("Sensex", sensex), ("Bank Nifty", bank)) if x is not None)]
    known = F.concat_ws(", ", *clauses)
    index = F.when(known == "", "Market index data isn't available right now.").otherwise(F.concat(known, F.lit(".")))
    lead = F.when(top_symbol.isNotNull(), F.concat(top_symbol, F.lit(" leads your watchlist, up "), F.format_string("%.1f%%", top_pct * 100)))
    weak = F.when(low_symbol.isNotNull() & (low_pct < 0), F.concat(low_symbol, F.lit(" is your weakest, down "), show(low_pct)))
    movers = F.concat_ws("; ", lead, weak)
    return F.when(movers == "", index).otherwise(F.concat(index, F.lit(" "), movers, F.lit(".")))
