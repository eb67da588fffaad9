"""DuckDB oracle SQL for the registered queries (the driver's correctness gate).

Written independently of the Spark plans: bars by plain GROUP BY, indicators by a
sequential recursive CTE (one row per bar, state carried from the previous bar), rolling
values by SQL window frames. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

R = 6


def rnd(expr: str, digits: int = R) -> str:
    scale = f"{float(10 ** digits)!r}"
    v = f"CAST({expr} AS DOUBLE)"
    unit = f"pow(10.0, CAST(floor(log10(abs({v}))) AS DOUBLE) - {float(digits - 1)!r})"
    return (f"(CASE WHEN abs({v}) < 1e6 THEN CAST(floor({v} * {scale} + 0.5) AS DOUBLE) / {scale} "
            f"ELSE CAST(CAST(CAST(floor({v} / {unit} + 0.5) AS BIGINT) AS VARCHAR) || 'e' || "
            f"CAST(CAST(floor(log10(abs({v}))) - {digits - 1} AS BIGINT) AS VARCHAR) AS DOUBLE) END)")


def ftxt(expr: str, digits: int) -> str:
    """``%.<digits>f`` text after ``floor(x*10^d + 0.5)/10^d`` (same steps as the Spark side)."""
    scale = f"{float(10 ** digits)!r}"
    return f"printf('%.{digits}f', CAST(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5) AS DOUBLE) / {scale})"


def tdiv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


def bucket(ts: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(CAST(floor(epoch_us({ts}) / {us}) * {us} AS BIGINT))"


# --- bars ---------------------------------------------------------------------------------

LINEITEM_BARS = f"""
li_ticks AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem WHERE l_quantity <> 0 AND l_extendedprice IS NOT NULL),
bars AS (
  SELECT symbol, 'D1' AS tf, {bucket('ts', 86400)} AS time,
         arg_min(price, (l_orderkey, l_linenumber, l_partkey)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, (l_orderkey, l_linenumber, l_partkey)) AS close,
         count(*) AS tick_volume
  FROM li_ticks GROUP BY symbol, {bucket('ts', 86400)})"""

ORDERS_BARS = f"""
bars AS (
  SELECT o_orderpriority AS symbol, 'D1' AS tf, {bucket('o_orderdate', 86400)} AS time,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         count(*) AS tick_volume
  FROM orders GROUP BY o_orderpriority, {bucket('o_orderdate', 86400)})"""


TAPE_BARS = f"""
tape AS (
  SELECT make_timestamp(CAST((946684800 + l_orderkey * 60) * 1000000 AS BIGINT)) AS ts, l_extendedprice / l_quantity AS price,
         l_linenumber, l_partkey
  FROM lineitem WHERE l_quantity <> 0 AND l_extendedprice IS NOT NULL),
bars AS (
  SELECT 'TAPE' AS symbol, 'M1' AS tf, {bucket('ts', 60)} AS time, arg_min(price, (l_linenumber, l_partkey, price)) AS open,
         max(price) AS high, min(price) AS low, arg_max(price, (l_linenumber, l_partkey, price)) AS close, count(*) AS tick_volume
  FROM tape GROUP BY {bucket('ts', 60)})"""


WALK_BARS = f"""
minutes AS (SELECT l_orderkey, sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS step, count(*) AS tick_volume
            FROM lineitem GROUP BY l_orderkey),
levels AS (SELECT 'W' || (l_orderkey % 3) AS symbol, 'M1' AS tf,
             make_timestamp(CAST((946684800 + l_orderkey * 60) * 1000000 AS BIGINT)) AS time, step, tick_volume,
             sum(step) OVER (PARTITION BY l_orderkey % 3 ORDER BY l_orderkey) AS level FROM minutes),
bars AS (
  SELECT symbol, tf, time, 1.1 + CAST(level - step AS DOUBLE) * 0.00001 AS open,
         1.1 + CAST(greatest(level - step, level) + tick_volume AS DOUBLE) * 0.00001 AS high,
         1.1 + CAST(least(level - step, level) - tick_volume AS DOUBLE) * 0.00001 AS low,
         1.1 + CAST(level AS DOUBLE) * 0.00001 AS close, tick_volume FROM levels)"""


def events_bars(tf: str, seconds: int, name: str = "bars") -> str:
    return f"""
{name} AS (
  SELECT event_type AS symbol, '{tf}' AS tf, {bucket('ts', seconds)} AS time,
         arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, value)) AS close, count(*) AS tick_volume
  FROM events GROUP BY event_type, {bucket('ts', seconds)})"""


NUMBERED = """
nb AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time) - 1 AS n FROM bars)"""


# --- sequential indicator state ----------------------------------------------------------


def _smooth(prev: str, x: str, s: int, p: int, alpha: float) -> str:
    return (
        f"CASE WHEN b.n - {s} < 0 THEN 0.0 WHEN b.n - {s} < {p} THEN {prev} + ({x}) / {p}.0 "
        f"ELSE {1.0 - alpha!r} * {prev} + {alpha!r} * ({x}) END"
    )


def _smooth0(x: str, s: int, p: int) -> str:
    return f"({x}) / {p}.0" if s == 0 else "0.0"


def _wsum(prev: str, x: str, p: int) -> str:
    return f"CASE WHEN b.n - 1 < {p - 1} THEN {prev} + ({x}) ELSE {prev} * {(p - 1) / p!r} + ({x}) END"


TR = "greatest(b.high - b.low, abs(b.high - r.close), abs(b.low - r.close))"
GAIN = "greatest(b.close - r.close, 0.0)"
LOSS = "greatest(r.close - b.close, 0.0)"
PDM = ("CASE WHEN (b.high - r.high) > 0 AND (b.high - r.high) > (r.low - b.low) "
       "THEN b.high - r.high ELSE 0.0 END")
MDM = ("CASE WHEN (r.low - b.low) > 0 AND (b.high - r.high) < (r.low - b.low) "
       "THEN r.low - b.low ELSE 0.0 END")

# (name, init at bar 0, step expression)
LEVEL1 = [
    ("atr", "0.0", _smooth("r.atr", TR, 1, 14, 1 / 14)),
    ("g", "0.0", _smooth("r.g", GAIN, 1, 14, 1 / 14)),
    ("l", "0.0", _smooth("r.l", LOSS, 1, 14, 1 / 14)),
    ("e2", _smooth0("close", 0, 2), _smooth("r.e2", "b.close", 0, 2, 2 / 3)),
    ("e9", _smooth0("close", 0, 9), _smooth("r.e9", "b.close", 0, 9, 2 / 10)),
    ("e12", _smooth0("close", 0, 12), _smooth("r.e12", "b.close", 0, 12, 2 / 13)),
    ("e21", _smooth0("close", 0, 21), _smooth("r.e21", "b.close", 0, 21, 2 / 22)),
    ("e26", _smooth0("close", 0, 26), _smooth("r.e26", "b.close", 0, 26, 2 / 27)),
    ("e200", _smooth0("close", 0, 200), _smooth("r.e200", "b.close", 0, 200, 2 / 201)),
    ("mf", "0.0", _smooth("r.mf", "b.close", 14, 12, 2 / 13)),
    ("ms", _smooth0("close", 0, 26), _smooth("r.ms", "b.close", 0, 26, 2 / 27)),
    ("mf11", "0.0", _smooth("r.mf11", "b.close", 16, 11, 2 / 12)),
    ("ms27", _smooth0("close", 0, 27), _smooth("r.ms27", "b.close", 0, 27, 2 / 28)),
    ("pdm", "0.0", _wsum("r.pdm", PDM, 14)),
    ("mdm", "0.0", _wsum("r.mdm", MDM, 14)),
    ("str", "0.0", _wsum("r.str", TR, 14)),
    ("atrl", "0.0", _smooth("r.atrl", f"CASE WHEN b.n > 199 THEN {TR} ELSE 0.0 END", 200, 14, 1 / 14)),
]

DX = """CASE WHEN n >= 14 AND abs(str) >= 1e-14
              AND abs(100.0 * pdm / str + 100.0 * mdm / str) >= 1e-14
         THEN 100.0 * abs(100.0 * pdm / str - 100.0 * mdm / str) / (100.0 * pdm / str + 100.0 * mdm / str) END"""

LEVEL2 = [
    ("adx", "0.0",
     "CASE WHEN b.n < 14 THEN 0.0 WHEN b.n <= 27 THEN r.adx + coalesce(b.dx, 0.0) / 14.0 "
     "WHEN b.dx IS NOT NULL THEN r.adx * (13.0 / 14.0) + b.dx / 14.0 ELSE r.adx END"),
    ("sig", "0.0", _smooth("r.sig", "coalesce(b.line, 0.0)", 25, 9, 0.2)),
    ("sig4", "0.0", _smooth("r.sig4", "coalesce(b.line4, 0.0)", 26, 4, 0.4)),
]


def ta_state(src: str = "nb", name: str = "ta") -> str:
    """CTEs ``<name>1`` (level 1), ``<name>1x`` (+dx, MACD lines) and ``<name>`` (+ADX, signals)."""
    t1, t1x, t2 = f"{name}1", f"{name}1x", f"{name}2"
    base = "symbol, tf, n, time, open, high, low, close, tick_volume"
    l1_init = ", ".join(f"CAST({init} AS DOUBLE) AS {nm}" for nm, init, _ in LEVEL1)
    l1_step = ", ".join(f"{step} AS {nm}" for nm, _, step in LEVEL1)
    l1_names = ", ".join(nm for nm, _, _ in LEVEL1)
    l2_init = ", ".join(f"CAST({init} AS DOUBLE) AS {nm}" for nm, init, _ in LEVEL2)
    l2_step = ", ".join(f"{step} AS {nm}" for nm, _, step in LEVEL2)
    bb = ", ".join(f"b.{c}" for c in base.split(", "))
    return f"""
{t1} AS (
  SELECT {base}, {l1_init} FROM {src} WHERE n = 0
  UNION ALL
  SELECT {bb}, {l1_step}
  FROM {t1} r JOIN {src} b ON b.symbol = r.symbol AND b.tf = r.tf AND b.n = r.n + 1),
{t1x} AS (
  SELECT {base}, {l1_names}, {DX} AS dx,
         CASE WHEN n >= 25 THEN mf - ms END AS line,
         CASE WHEN n >= 26 THEN mf11 - ms27 END AS line4
  FROM {t1}),
{t2} AS (
  SELECT {base}, {l2_init} FROM {t1x} WHERE n = 0
  UNION ALL
  SELECT {bb}, {l2_step}
  FROM {t2} r JOIN {t1x} b ON b.symbol = r.symbol AND b.tf = r.tf AND b.n = r.n + 1),
{name} AS (
  SELECT x.*, t.adx, t.sig, t.sig4 FROM {t1x} x JOIN {t2} t USING (symbol, tf, n))"""


# Indicator values with their warm-up masks, over ``ta``.
IND = {
    "atr": "CASE WHEN n >= 14 THEN atr END",
    "rsi_14": "CASE WHEN n >= 14 THEN CASE WHEN abs(g + l) < 1e-14 THEN 0.0 ELSE 100.0 * g / (g + l) END END",
    "ema_2": "CASE WHEN n >= 1 THEN e2 END",
    "ema_9": "CASE WHEN n >= 8 THEN e9 END",
    "ema_12": "CASE WHEN n >= 11 THEN e12 END",
    "ema_21": "CASE WHEN n >= 20 THEN e21 END",
    "ema_26": "CASE WHEN n >= 25 THEN e26 END",
    "ema_200": "CASE WHEN n >= 199 THEN e200 END",
    "macd": "CASE WHEN n >= 33 THEN line END",
    "macd_signal": "CASE WHEN n >= 33 THEN sig END",
    "macd_hist": "CASE WHEN n >= 33 THEN line - sig END",
    "macd4": "CASE WHEN n >= 29 THEN line4 END",
    "macd4_signal": "CASE WHEN n >= 29 THEN sig4 END",
    "macd4_hist": "CASE WHEN n >= 29 THEN line4 - sig4 END",
    "adx": "CASE WHEN n >= 27 THEN adx END",
    "atr_lbl": "CASE WHEN n >= 213 THEN atrl END",
}


def wnd(frame: str, key: str = "symbol, tf") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY n {frame})"


def trailing(p: int) -> str:
    return wnd(f"ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW")


def masked_agg(agg: str, x: str, p: int) -> str:
    return f"CASE WHEN count({x}) {trailing(p)} = {p} THEN {agg} {trailing(p)} END"


def sma(x: str, p: int) -> str:
    return masked_agg(f"avg({x})", x, p)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {wnd('')}"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) {wnd('')}"


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip("\n") for p in parts)
