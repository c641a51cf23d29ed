"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn reads `### role: text</turn>` and a line feed. In roles and texts, a backslash becomes `\\s`, `###`
becomes `\\h`, `</turn>` becomes `\\e` and, in roles, a colon becomes `\\c`; so no text can forge a control
string, and the escapes are undone by plain replacements.

Windows: running sums of turn tokens (per conversation, in order of turn) choose spans of whole turns. A
window holds the leading system turn if there is one, up to `history` tokens of the turns before its first
new turn, and as many new turns as the budget allows, one at least. Where even the first new turn doesn't
fit with history, the history is left out; a turn above the budget stands alone, whole. The loss mask has the
assistant texts of new turns only: a turn that is repeated as history is masked, so each target counts once.

Nulls: a null text or role is empty; null turns come first; rows with a null conv_id are one conversation.
Repeated turn numbers are ordered by role, then text. An empty table gives an empty result. Extra columns
are not read. Sorting, sums and range frames stream; the window texts of one conversation meet in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("\\c"), F.lit(":")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\h"), F.lit("###")), F.lit("\\s"), F.lit("\\"))


def default_tokens(text: Column) -> Column:
    """A token for each 4 characters, and 4 for the turn's marks."""
    return F.ceil(F.length(text) / 4) + 4


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=default_tokens) -> DataFrame:
    """conv_id, window, text, mask array<struct<start, length>> (code points), n_repeated (turns that earlier windows have), n_turns (all in this window), n_tokens."""
    key = Window.partitionBy("conv_id")
    order = key.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    header = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", tokens(F.col("text")).cast("long").alias("tok"), header.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.select("*", F.row_number().over(order).alias("pos"), F.first(F.struct("role", "tok")).over(upto).alias("lead"))
    lead = F.col("lead.role") == "system"
    new = ~(lead & (F.col("pos") == 1))
    size = F.length("head") + F.length("body") + 8
    rows = rows.select(
        "*", lead.alias("sys"), F.when(lead, F.col("lead.tok")).otherwise(F.lit(0)).alias("sys_tok"), new.alias("new"),
        F.sum(F.when(new, F.col("tok")).otherwise(F.lit(0))).over(upto).alias("p_end"), F.sum(F.when(new, size).otherwise(F.lit(0))).over(upto).alias("q_end"),
    )
    rows = rows.select("*", F.when(F.col("new"), F.col("p_end") - F.col("tok")).otherwise(F.lit(-1)).cast("long").alias("p"), F.when(F.col("new"), F.col("q_end") - size).otherwise(F.lit(-1)).cast("long").alias("q"))
    # the earliest turn within `history` tokens before this one starts
    back = Window.partitionBy("conv_id", "new").orderBy("p").rangeBetween(-history, 0)
    rows = rows.select("*", F.min(F.struct("pos", "p", "q")).over(back).alias("h"))
    rows = rows.select("conv_id", F.struct("pos", "new", "tok", "sys_tok", "p", "p_end", "q", "h", (F.col("role") == "assistant").alias("target"), F.length("head").alias("hl"), F.length("body").alias("bl"), F.concat("head", "body", F.lit("</turn>\n")).alias("line")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.select("conv_id", "turns", F.expr("if(turns[0].new, 0, 1)").alias("lead"), F.expr("transform(filter(turns, t -> t.new), t -> struct(t.pos, t.tok, t.sys_tok, t.p, t.p_end, t.q, t.h))").alias("sums"))
    starts = F.expr(f"""
        if(size(sums) = 0, array(struct(2 as pos, 2 as base, 0L as q)),
          aggregate(sums, struct(-1L as p, cast(array() as array<struct<pos: int, base: int, q: bigint>>) as starts),
            (a, t) -> case
              when size(a.starts) > 0 and t.p_end - a.p + t.sys_tok <= {budget} then a
              when t.p_end - t.h.p + t.sys_tok <= {budget} then struct(t.h.p as p, array_append(a.starts, struct(t.pos as pos, t.h.pos as base, t.h.q as q)) as starts)
              else struct(t.p as p, array_append(a.starts, struct(t.pos as pos, t.pos as base, t.q as q)) as starts) end,
            a -> a.starts))""")
    # cut the turns into windows before these become rows, so that no row carries all turns; there is always a window, and the
    # outer form keeps the optimizer from testing for one with a second copy of all this
    cut = "transform(starts, (w, i) -> struct(i as window, w as w, slice(turns, w.base, coalesce(get(starts, i + 1).pos, size(turns) + 1) - w.base) as m))"
    wins = convs.select("conv_id", "turns", "lead", starts.alias("starts")).select("conv_id", "lead", F.expr("if(lead = 1, turns[0], null)").alias("s"), F.expr(cut).alias("ws"))
    wins = wins.select("conv_id", "lead", "s", F.explode_outer("ws").alias("x")).select("conv_id", "lead", "s", "x.*")
    system = F.expr("coalesce(s.hl + s.bl + 8, 0)")
    return wins.select("conv_id", "window", "w", "m", "s", "lead", system.alias("at")).select(
        "conv_id", "window", F.concat(F.coalesce("s.line", F.lit("")), F.array_join(F.expr("transform(m, t -> t.line)"), "")).alias("text"),
        F.expr("transform(filter(m, t -> t.target and t.pos >= w.pos), t -> struct(cast(at + t.q - w.q + t.hl as int) as start, t.bl as length))").alias("mask"),
        F.expr("w.pos - w.base + if(window > 0, lead, 0)").alias("n_repeated"), F.expr("size(m) + lead").alias("n_turns"),
        F.expr("aggregate(m, coalesce(s.tok, 0L), (a, t) -> a + t.tok)").alias("n_tokens"),
    )


def parse_windows(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns array<struct<role, text>> (new turns only) and targets array<string> (texts under the mask), read back from the formatted text."""
    lines = windows.select("*", F.expr(r"split(text, '</turn>\n')").alias("lines"))
    lines = lines.select("*", F.expr("slice(lines, n_repeated + 1, size(lines) - 1 - n_repeated)").alias("fresh"))
    return lines.select(
        "conv_id", "window",
        F.transform("fresh", lambda x: F.struct(unescape(F.substr(x, F.lit(5), F.instr(x, ": ") - 5)).alias("role"), unescape(F.substr(x, F.instr(x, ": ") + 2, F.length(x))).alias("text"))).alias("turns"),
        F.transform("mask", lambda m: unescape(F.substr(F.col("text"), m["start"] + 1, m["length"]))).alias("targets"),
        F.length("text").alias("chars"),
    )


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted windows."""
    back = parse_windows(windows)
    back = back.select(
        "conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("targets", "").alias("loss"), "chars",
    )
    joined = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
