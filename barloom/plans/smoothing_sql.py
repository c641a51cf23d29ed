"""Recursive smoothing in DuckDB SQL: one row of a symbol follows from the one before."""

_A = "(1.0/14)"


def _step(prev: str, x: str, a: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN {prev} WHEN {prev} IS NULL THEN {x} ELSE (1 - {a}) * {prev} + {a} * {x} END"


_EMAS = (12, 26, 20, 50, 200)


def smoothing(bars: str = "bars") -> str:
    """CTEs src and smooth: symbol, d and the smoothed columns, NULL through their warm-up."""
    src = f"""src AS MATERIALIZED (SELECT *,
        CASE WHEN r = 15 THEN avg(gain) OVER w14 WHEN r > 15 THEN gain END AS xg, CASE WHEN r = 15 THEN avg(loss) OVER w14 WHEN r > 15 THEN loss END AS xl,
        CASE WHEN r = 14 THEN avg(tr) OVER w14 WHEN r > 14 THEN tr END AS xt, CASE WHEN r = 14 THEN avg(pdm) OVER w14 WHEN r > 14 THEN pdm END AS xp, CASE WHEN r = 14 THEN avg(mdm) OVER w14 WHEN r > 14 THEN mdm END AS xm
      FROM (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
          CASE WHEN high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS mdm
        FROM (SELECT *, row_number() OVER s AS r, lag(close) OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl FROM {bars} WINDOW s AS (PARTITION BY symbol ORDER BY d)))
      WINDOW w14 AS (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING))"""
    first = ", ".join(f"close AS e{n}" for n in _EMAS)
    step = ", ".join(_step(f"f.e{n}", "s.close", f"(2.0/{n + 1})") + f" AS n{n}" for n in _EMAS)
    fold = f"""fold AS (
      SELECT symbol, r, {first}, NULL::double AS sig, NULL::double AS g, NULL::double AS l, NULL::double AS t, NULL::double AS p, NULL::double AS m, NULL::double AS ax, 1.0::double AS wt FROM src WHERE r = 1
      UNION ALL
      SELECT symbol, r, {", ".join(f"n{n}" for n in _EMAS)}, nsig, ng, nl, nt, np, nm,
        CASE WHEN dx IS NULL THEN ax WHEN ax IS NULL THEN dx ELSE (wt * {_A[:-1]} * 13) * ax + {_A} * dx) / (wt * {_A[:-1]} * 13) + {_A}) END,
        CASE WHEN dx IS NULL AND ax IS NOT NULL THEN wt * (1 - {_A}) ELSE 1.0 END
      FROM (SELECT *, CASE WHEN np + nm > 0 THEN 100 * abs(np - nm) / (np + nm) END AS dx FROM (
        SELECT s.symbol, s.r, {step}, {_step("f.g", "s.xg", _A)} AS ng, {_step("f.l", "s.xl", _A)} AS nl, {_step("f.t", "s.xt", _A)} AS nt, {_step("f.p", "s.xp", _A)} AS np, {_step("f.m", "s.xm", _A)} AS nm,
          {_step("f.sig", "(CASE WHEN s.r >= 26 THEN (" + _step("f.e12", "s.close", "(2.0/13)") + ") - (" + _step("f.e26", "s.close", "(2.0/27)") + ") END)", "0.2")} AS nsig, f.ax, f.wt
        FROM fold f JOIN src s ON s.symbol = f.symbol AND s.r = f.r + 1)))"""
    fold = fold.replace(f"(wt * {_A[:-1]} * 13) * ax", "(wt * (13.0/14) * ax").replace(f"(wt * {_A[:-1]} * 13) + {_A})", f"(wt * (13.0/14) + {_A})")
    out = """smooth AS MATERIALIZED (SELECT s.symbol, s.d, CASE WHEN s.r >= 20 THEN e20 END AS ema_20, CASE WHEN s.r >= 50 THEN e50 END AS ema_50, CASE WHEN s.r >= 200 THEN e200 END AS ema_200,
      CASE WHEN s.r >= 26 THEN e12 - e26 END AS macd, CASE WHEN s.r >= 34 THEN sig END AS macd_signal,
      CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi_14, t AS atr_14, ax AS adx_14
      FROM src s JOIN fold f ON s.symbol = f.symbol AND s.r = f.r)"""
    return f"{src}, {fold}, {out}"
