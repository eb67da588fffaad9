"""Oracle SQL text per registered query (see ``oracles.py`` for the building blocks)."""

from __future__ import annotations

from oracles import (
    IND, ftxt, LINEITEM_BARS, NUMBERED, ORDERS_BARS, TAPE_BARS, WALK_BARS, bucket, events_bars, lag, lead, masked_agg, rnd, sma,
    ta_state, tdiv, trailing, with_ctes,
)

BARS_OUT = f"symbol, tf, time, {rnd('open')} AS open, {rnd('high')} AS high, {rnd('low')} AS low, " \
           f"{rnd('close')} AS close, tick_volume"
KEYCOLS = "symbol, tf, time, n"


def _li(*more: str) -> str:
    return with_ctes(LINEITEM_BARS, NUMBERED, *more)


def _ta_query(cols: dict[str, str]) -> str:
    sel = ", ".join(f"{rnd(expr)} AS {name}" for name, expr in cols.items())
    return _li(ta_state()) + f"\nSELECT {KEYCOLS}, {sel} FROM ta"


SQL: dict[str, str] = {}

SQL["bars_lineitem_d1"] = with_ctes(LINEITEM_BARS) + f"\nSELECT {BARS_OUT} FROM bars"
SQL["bars_orders_d1"] = with_ctes(ORDERS_BARS) + f"\nSELECT {BARS_OUT} FROM bars"
SQL["bars_events_m15"] = with_ctes(events_bars("M15", 900)) + f"\nSELECT {BARS_OUT} FROM bars"
SQL["bars_rollup_m15_h4"] = with_ctes(events_bars("H4", 14400)) + f"\nSELECT {BARS_OUT} FROM bars"
SQL["last_300_bars"] = with_ctes(LINEITEM_BARS) + f"""
SELECT {BARS_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time DESC) AS r FROM bars) WHERE r <= 300"""
SQL["last_7000_bars"] = with_ctes(TAPE_BARS) + f"""
SELECT {BARS_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time DESC) AS r FROM bars) WHERE r <= 7000"""
SQL["latest_tick"] = f"""
SELECT event_type AS symbol, max(ts) AS ts, {rnd('arg_max(value, ts)')} AS bid,
       {rnd('arg_max(value * 1.0002, ts)')} AS ask
FROM events GROUP BY event_type"""

SQL["ind_sma"] = _li() + f"\nSELECT {KEYCOLS}, " + ", ".join(
    f"{rnd(sma('close', p))} AS sma_{p}" for p in (10, 30, 200)) + " FROM nb"
SQL["ind_ema"] = _ta_query({f"ema_{p}": IND[f"ema_{p}"] for p in (2, 9, 12, 21, 26, 200)})
def _ema_of(p: int, h: int) -> str:
    """EMA over the newest ``h`` bars, term by term: the first ``p`` bars' mean decayed, then each later bar."""
    keep = 1.0 - 2.0 / (p + 1)
    frame = f"OVER (PARTITION BY symbol, tf ORDER BY n ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    value = (f"list_sum(list_transform(list(close) {frame}, lambda x, i: x * CASE WHEN i <= {p} THEN {keep ** (h - p) / p!r} "
             f"ELSE {1.0 - keep!r} * pow({keep!r}, CAST({h} - i AS DOUBLE)) END))")
    return f"CASE WHEN n >= {h - 1} THEN {value} END"


SQL["ind_ema_history"] = _li() + f"""
SELECT {KEYCOLS}, {rnd('a')} AS ema_200_of_200, {rnd('b')} AS ema_12_of_60, {rnd('c')} AS ema_26_of_60
FROM (SELECT *, {_ema_of(200, 200)} AS a, {_ema_of(12, 60)} AS b, {_ema_of(26, 60)} AS c FROM nb)"""
SQL["ind_bbands"] = _li() + f"""
SELECT {KEYCOLS},
  {rnd(sma('close', 20) + ' + 2.0 * ' + masked_agg('stddev_pop(close)', 'close', 20))} AS bb_upper,
  {rnd(sma('close', 20))} AS bb_middle,
  {rnd(sma('close', 20) + ' - 2.0 * ' + masked_agg('stddev_pop(close)', 'close', 20))} AS bb_lower
FROM nb"""
SQL["ind_macd"] = _ta_query({k: IND[k] for k in ("macd", "macd_signal", "macd_hist", "macd4", "macd4_signal", "macd4_hist")})
SQL["ind_rsi"] = _ta_query({"rsi_14": IND["rsi_14"]})
SQL["ind_atr"] = _ta_query({
    "atr": IND["atr"],
    "natr": f"CASE WHEN close = 0 THEN 0.0 ELSE 100.0 * ({IND['atr']}) / close END",
})
SQL["ind_adx"] = _ta_query({"adx": IND["adx"]})
SQL["ind_adx_flat"] = with_ctes(LINEITEM_BARS, NUMBERED.replace("nb AS", "nb0 AS"), """
nb AS (SELECT * REPLACE (CASE WHEN n >= 200 THEN 100.0 ELSE open END AS open, CASE WHEN n >= 200 THEN 100.0 ELSE high END AS high,
  CASE WHEN n >= 200 THEN 100.0 ELSE low END AS low, CASE WHEN n >= 200 THEN 100.0 ELSE close END AS close) FROM nb0)""",
    ta_state()) + f"\nSELECT {KEYCOLS}, {rnd(IND['adx'])} AS adx FROM ta"
SQL["ind_long_m1"] = with_ctes(TAPE_BARS, NUMBERED, ta_state()) + f"""
SELECT {KEYCOLS}, {rnd(IND['ema_12'])} AS ema_12, {rnd(IND['ema_200'])} AS ema_200, {rnd(IND['atr'])} AS atr,
  {rnd(IND['adx'])} AS adx, {rnd(sma('close', 200))} AS sma_200 FROM ta"""
SQL["ind_mfi"] = _li() + f"""
, mf AS (
  SELECT *, (high + low + close) / 3.0 AS tp, {lag('(high + low + close) / 3.0')} AS ptp FROM nb),
mf2 AS (
  SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * tick_volume ELSE 0.0 END END AS pos,
            CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * tick_volume ELSE 0.0 END END AS neg
  FROM mf)
SELECT {KEYCOLS}, {rnd(f'''CASE WHEN count(pos) {trailing(14)} = 14 THEN
    CASE WHEN sum(pos) {trailing(14)} + sum(neg) {trailing(14)} < 1.0 THEN 0.0
    ELSE 100.0 * sum(pos) {trailing(14)} / (sum(pos) {trailing(14)} + sum(neg) {trailing(14)}) END END''')} AS mfi
FROM mf2"""
SQL["ind_linreg_slope"] = _li() + f"\nSELECT {KEYCOLS}, " + ", ".join(
    f"{rnd(masked_agg('regr_slope(close, CAST(n AS DOUBLE))', 'close', p))} AS slope_{p}" for p in (20, 30)
) + " FROM nb"
SQL["ind_rolling"] = _li() + f"""
SELECT {KEYCOLS}, {rnd(sma('close', 5))} AS mean_5,
  {rnd(masked_agg('stddev_samp(close)', 'close', 10))} AS std_10,
  {rnd(lag('close'))} AS prev_close,
  {rnd(tdiv('close', lag('close')) + ' - 1.0')} AS pct_1,
  {rnd(tdiv('close', lag('close', 3)) + ' - 1.0')} AS pct_3,
  {rnd(lead('close', 5))} AS close_lead_5
FROM nb"""


# --- feature sets ---------------------------------------------------------------------------


def _fwd(x: str, k: int, agg: str) -> str:
    return f"{agg}({x}) OVER (PARTITION BY symbol, tf ORDER BY n ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"


def barrier_ctes(version: str) -> str:
    """CTE ``feat``: V11/V10 features + G1 label (rows from bar 199, features present)."""
    W, m = (12, 1.25) if version == "v11" else (14, 1.3)
    sp = 20 if version == "v11" else 30
    t14 = trailing(14)
    return ta_state() + f""",
v0 AS (
  SELECT *, {IND['atr']} AS atr_v, {IND['adx']} AS adx_v, {IND['rsi_14']} AS rsi_v,
         {IND['macd_hist']} AS hist_v, {IND['atr_lbl']} AS atrl_v, (high + low + close) / 3.0 AS tp
  FROM ta),
v1 AS (
  SELECT *, {lag('tp')} AS ptp, {sma('close', 20)} AS mid,
         {masked_agg('stddev_pop(close)', 'close', 20)} AS sd,
         {sma('close', 200)} AS sma200,
         {masked_agg('regr_slope(close, CAST(n AS DOUBLE))', 'close', sp)} AS slope,
         {sma('atr_v', 50)} AS atr50,
         {_fwd('close', W, 'max')} AS fmax, {_fwd('close', W, 'min')} AS fmin,
         {lead('close', W)} AS lead_w
  FROM v0),
v2 AS (
  SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * tick_volume ELSE 0.0 END END AS pos,
            CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * tick_volume ELSE 0.0 END END AS neg
  FROM v1),
v3 AS (
  SELECT *, CASE WHEN count(pos) {t14} = 14 THEN
      CASE WHEN sum(pos) {t14} + sum(neg) {t14} < 1.0 THEN 0.0
      ELSE 100.0 * sum(pos) {t14} / (sum(pos) {t14} + sum(neg) {t14}) END END AS mfi_v,
    mid + 2.0 * sd AS up, mid - 2.0 * sd AS lo,
    CASE WHEN atrl_v IS NULL THEN NULL ELSE greatest(0.0035, {tdiv(f'{m} * atrl_v', 'close')}) END AS thr,
    {tdiv('fmax - close', 'close')} AS ret_up, {tdiv('close - fmin', 'close')} AS ret_dn
  FROM v2),
feat AS (
  SELECT symbol, tf, time, n, open, high, low, close, tick_volume,
    {('slope / (close + 1e-9)' if version == 'v11' else tdiv('slope', 'close'))} AS {'slope_20' if version == 'v11' else 'slope_30'},
    adx_v AS adx,
    (up - lo) / (atr_v + 1e-9) AS sqz_idx,
    {tdiv('atr_v', 'atr50')} AS atr_ratio,
    rsi_v AS rsi_14, mfi_v AS mfi,
    hist_v / (close + 1e-9) AS macd_hist,
    (close - lo) / (up - lo + 1e-9) AS price_in_bb,
    (close - sma200) / (sma200 + 1e-9) AS dist_sma_200,
    (close - mid) / (mid + 1e-9) AS dist_sma_20,
    CASE WHEN close = 0 THEN 0.0 ELSE 100.0 * atr_v / close END AS natr,
    {('(close - open) / (high - low + 1e-9)' if version == 'v11' else 'abs(close - open) / (high - low + 1e-9)')} AS body_size,
    (high - greatest(close, open)) / (high - low + 1e-9) AS upper_wick,
    CAST(hour(time) AS INTEGER) AS hour,
    CAST(CASE WHEN hour(time) BETWEEN 14 AND 20 THEN 1 ELSE 0 END AS INTEGER) AS market_active,
    CAST(CASE WHEN ret_up > thr AND ret_dn < ret_up * 0.5 THEN 1
              WHEN ret_dn > thr AND ret_up < ret_dn * 0.5 THEN -1 ELSE 0 END AS INTEGER) AS label,
    lead_w IS NOT NULL AS label_valid
  FROM v3 WHERE n >= 199)"""


V11_COLS = ["slope_20", "adx", "sqz_idx", "atr_ratio", "rsi_14", "mfi", "macd_hist", "price_in_bb",
            "dist_sma_200", "dist_sma_20", "natr", "body_size", "upper_wick", "hour", "market_active"]
V10_COLS = ["slope_30", "adx", "sqz_idx", "rsi_14", "mfi", "macd_hist", "price_in_bb", "dist_sma_200",
            "natr", "body_size", "hour", "market_active"]
INT_COLS = {"hour", "market_active", "doji", "engulfing"}


def _feature_select(cols: list[str]) -> str:
    sel = ", ".join(c if c in INT_COLS else f"{rnd(c)} AS {c}" for c in cols)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"SELECT {KEYCOLS}, {sel}, label, label_valid FROM feat WHERE {nn}"


SQL["features_v11"] = _li(barrier_ctes("v11")) + "\n" + _feature_select(V11_COLS)
SQL["features_v10"] = _li(barrier_ctes("v10")) + "\n" + _feature_select(V10_COLS)

M25_COLS = [
    "ema_cross", "price_to_ema12", "price_to_ema26", "ema12_slope", "ema26_slope",
    "macd_line", "macd_signal", "macd_hist", "macd_cross", "macd_hist_slope",
    "rsi_14", "rsi_slope", "rsi_buy_signal", "rsi_sell_signal", "rsi_trend_strength",
    "price_change", "price_momentum", "volatility", "volatility_ratio",
    "body_ratio", "body_momentum", "upper_shadow_ratio", "lower_shadow_ratio", "doji", "engulfing",
]


def momentum_ctes() -> str:
    """CTE ``feat``: the 25-column set + G2 label."""
    return ta_state() + f""",
m0 AS (
  SELECT *, {IND['ema_12']} AS e12v, {IND['ema_26']} AS e26v, {IND['rsi_14']} AS rsiv,
    {IND['macd']} AS macdv, {IND['macd_signal']} AS sigv, {IND['macd_hist']} AS histv,
    abs(close - open) AS body, abs(close - open) / (high - low + 1e-10) AS body_ratio,
    CASE WHEN close > open THEN 1 ELSE -1 END AS dir
  FROM ta),
m1 AS (
  SELECT *, {tdiv(masked_agg('stddev_samp(close)', 'close', 10), 'close')} AS volatility,
    e12v - {lag('e12v')} AS d12, e26v - {lag('e26v')} AS d26, histv - {lag('histv')} AS dh,
    rsiv - {lag('rsiv')} AS dr,
    body_ratio - {sma('body_ratio', 5)} AS body_momentum,
    {lag('dir')} AS pdir, {lag('body')} AS pbody,
    {tdiv('close', lag('close'))} - 1.0 AS price_change,
    {tdiv('close', lag('close', 3))} - 1.0 AS price_momentum,
    {tdiv(lead('close', 5) + ' - close', 'close')} AS fr
  FROM m0),
feat AS (
  SELECT symbol, tf, time, n,
    {tdiv('e12v - e26v', 'e26v')} AS ema_cross,
    {tdiv('close - e12v', 'e12v')} AS price_to_ema12,
    {tdiv('close - e26v', 'e26v')} AS price_to_ema26,
    {sma('d12', 3)} AS ema12_slope, {sma('d26', 3)} AS ema26_slope,
    {tdiv('macdv', 'close')} AS macd_line, {tdiv('sigv', 'close')} AS macd_signal,
    {tdiv('histv', 'close')} AS macd_hist, {tdiv('macdv - sigv', 'close')} AS macd_cross,
    {sma('dh', 3)} AS macd_hist_slope,
    rsiv AS rsi_14, {sma('dr', 3)} AS rsi_slope,
    (rsiv - 60.0) / 40.0 AS rsi_buy_signal, (rsiv - 40.0) / 40.0 AS rsi_sell_signal,
    abs(rsiv - 50.0) / 50.0 AS rsi_trend_strength,
    price_change, price_momentum, volatility,
    {tdiv('volatility', sma('volatility', 20))} AS volatility_ratio,
    body_ratio, body_momentum,
    (high - greatest(open, close)) / (high - low + 1e-10) AS upper_shadow_ratio,
    (least(open, close) - low) / (high - low + 1e-10) AS lower_shadow_ratio,
    CAST(CASE WHEN body_ratio < 0.1 THEN 1 ELSE 0 END AS INTEGER) AS doji,
    CAST(CASE WHEN dir = 1 AND pdir = -1 AND body > pbody * 1.5 THEN 1
              WHEN dir = -1 AND pdir = 1 AND body > pbody * 1.5 THEN -1 ELSE 0 END AS INTEGER) AS engulfing,
    CAST(CASE WHEN fr > 0.002 THEN 1 WHEN fr < -0.002 THEN -1 ELSE 0 END AS INTEGER) AS label,
    TRUE AS label_valid
  FROM m1)"""


SQL["features_momentum25"] = _li(momentum_ctes()) + "\n" + _feature_select(M25_COLS)

SQL["features_simple4"] = _li(ta_state()) + f"""
, s AS (
  SELECT symbol, tf, time, n, {sma('close', 10)} AS sma_10, {sma('close', 30)} AS sma_30,
         {IND['rsi_14']} AS rsi_14, {tdiv('close', lag('close'))} - 1.0 AS price_change FROM ta)
SELECT {KEYCOLS}, {rnd('sma_10')} AS sma_10, {rnd('sma_30')} AS sma_30, {rnd('rsi_14')} AS rsi_14,
       {rnd('price_change')} AS price_change
FROM s WHERE sma_10 IS NOT NULL AND sma_30 IS NOT NULL AND rsi_14 IS NOT NULL AND price_change IS NOT NULL"""


def _triple_barrier() -> str:
    cases = []
    for j in range(1, 11):
        cases.append(f"WHEN {lead('high', j)} >= close * 1.01 THEN 1 WHEN {lead('low', j)} <= close * (1 - 0.008) THEN -1")
    return ("CAST(CASE WHEN " + lead("close", 10) + " IS NULL THEN 0 " + " ".join(cases) + " ELSE 0 END AS INTEGER)")


SQL["labels_triple_barrier"] = _li() + f"\nSELECT {KEYCOLS}, {_triple_barrier()} AS label FROM nb"


# --- signals --------------------------------------------------------------------------------


def _signals_cte() -> str:
    return ta_state() + f""",
s0 AS (
  SELECT *, {IND['ema_2']} AS ema_2v, {IND['ema_9']} AS ema_9v, {IND['ema_12']} AS ema_12v,
    {IND['ema_21']} AS ema_21v, {IND['ema_26']} AS ema_26v, {IND['ema_200']} AS ema_200v,
    {IND['rsi_14']} AS rsiv, {IND['macd']} AS macdv, {IND['macd_signal']} AS sigv,
    {IND['macd4']} AS m4, {IND['macd4_hist']} AS h4, {sma('close', 20)} AS mid
  FROM ta),
s1 AS (
  SELECT *, {lag('macdv')} AS pm, {lag('sigv')} AS ps, {lag('ema_2v')} AS pma, {lag('mid')} AS pmid,
    {lag('h4')} AS ph4
  FROM s0),
s2 AS (
  SELECT *,
    CASE WHEN n >= 99 THEN
      CASE WHEN pm <= ps AND macdv > sigv THEN 'BUY' WHEN pm >= ps AND macdv < sigv THEN 'SELL'
           WHEN macdv > sigv THEN 'BULLISH' WHEN macdv < sigv THEN 'BEARISH' ELSE 'NEUTRAL' END END AS macd_state,
    CASE WHEN n >= 99 AND ema_12v > ema_26v THEN 'BULLISH' WHEN n >= 99 AND ema_12v < ema_26v THEN 'BEARISH'
         ELSE 'NEUTRAL' END AS ema_signal,
    CASE WHEN n >= 99 AND rsiv > 60 THEN 'BULLISH' WHEN n >= 99 AND rsiv < 40 THEN 'BEARISH'
         ELSE 'NEUTRAL' END AS rsi_signal,
    coalesce(pma <= pmid AND ema_2v > mid AND (m4 < h4 OR m4 < ph4), FALSE) AS bb_buy,
    coalesce(pma >= pmid AND ema_2v < mid AND (m4 > h4 OR m4 > ph4), FALSE) AS bb_sell,
    CASE WHEN close > ema_200v THEN 'BULLISH' WHEN close < ema_200v THEN 'BEARISH' ELSE 'NEUTRAL' END AS tr,
    CASE WHEN close > ema_200v THEN '>' WHEN close < ema_200v THEN '<' ELSE '≈' END AS rel,
    coalesce(n >= 99 AND {tdiv('abs(ema_9v - ema_21v)', 'ema_21v')} * 100.0 < 0.1 AND abs(macdv) < 0.0005, FALSE) AS sideways,
    CAST(CASE WHEN macdv > 0 THEN 1 WHEN macdv < 0 THEN -1 ELSE 0 END AS INTEGER) AS macd_zero
  FROM s1),
sig AS (
  SELECT *,
    CASE WHEN n < 49 THEN 'NEUTRAL' WHEN bb_buy THEN 'BULLISH' WHEN bb_sell THEN 'BEARISH' ELSE 'NEUTRAL' END AS bb_signal,
    CASE WHEN n < 49 THEN '' WHEN bb_buy THEN 'MA>BB_mid, MACD<Hist' WHEN bb_sell THEN 'MA<BB_mid, MACD>Hist'
         ELSE 'MA:' || {ftxt('ema_2v', 5)} || ' BB:' || {ftxt('mid', 5)} END AS bb_reason,
    CASE WHEN n >= 199 THEN tr ELSE 'NEUTRAL' END AS trend,
    CASE WHEN n >= 199 THEN printf('(%s price %s EMA200)', CASE WHEN tf IN ('H4', 'D1') THEN tf ELSE 'H1' END, rel)
         ELSE '' END AS trend_reason,
    CASE WHEN ema_signal = 'BULLISH' AND macd_zero = 1 AND rsi_signal = 'BULLISH' THEN 'BULLISH'
         WHEN ema_signal = 'BEARISH' AND macd_zero = -1 AND rsi_signal = 'BEARISH' THEN 'BEARISH'
         ELSE 'NEUTRAL' END AS combined
  FROM s2)"""


SQL["strategy_signals"] = _li(_signals_cte()) + f"""
SELECT {KEYCOLS}, macd_state, ema_signal, rsi_signal, bb_signal, bb_reason, trend, trend_reason, sideways,
  macd_zero, combined,
  CASE WHEN trend = 'BULLISH' AND combined = 'BULLISH' THEN 'BULLISH'
       WHEN trend = 'BEARISH' AND combined = 'BEARISH' THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_combined
FROM sig"""

PROBS = """
  (n % 7 + 1) / ((n % 7 + 1) + (n % 5 + 1) + (n % 3 + 1)) AS p_sell,
  (n % 5 + 1) / ((n % 7 + 1) + (n % 5 + 1) + (n % 3 + 1)) AS p_hold,
  (n % 3 + 1) / ((n % 7 + 1) + (n % 5 + 1) + (n % 3 + 1)) AS p_buy"""

ARGMAX = ("CASE WHEN p_sell >= p_hold AND p_sell >= p_buy THEN -1 "
          "WHEN p_hold >= p_buy THEN 0 ELSE 1 END")


def _gate(th: float) -> str:
    return f"CASE WHEN greatest(p_sell, p_hold, p_buy) >= {th} THEN {ARGMAX} ELSE 0 END"


SQL["signals_walk"] = with_ctes(WALK_BARS, NUMBERED, _signals_cte()) + f"""
, pr AS (SELECT *, {PROBS} FROM sig),
g AS (SELECT *, CASE WHEN trend = 'BULLISH' AND combined = 'BULLISH' THEN 'BULLISH'
                     WHEN trend = 'BEARISH' AND combined = 'BEARISH' THEN 'BEARISH' ELSE 'NEUTRAL' END AS trend_combined,
             CASE {ARGMAX} WHEN 1 THEN 'BULLISH' WHEN -1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS ai FROM pr)
SELECT {KEYCOLS}, macd_state, ema_signal, rsi_signal, bb_signal, trend, sideways, macd_zero, combined, trend_combined,
  CASE symbol WHEN 'W0' THEN ai WHEN 'W1' THEN bb_signal ELSE CASE WHEN sideways THEN 'NEUTRAL' ELSE trend_combined END END AS decision
FROM g"""

LIMIT = "CASE WHEN adx > 25 THEN 0.00012 ELSE 0.00006 END"

SQL["model_signal_gates"] = _li(barrier_ctes("v11")) + f"""
, g0 AS (SELECT *, {PROBS} FROM feat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in V11_COLS)}),
g1 AS (SELECT *, CAST({ARGMAX} AS INTEGER) AS model_class, CAST({_gate(0.54)} AS INTEGER) AS gated FROM g0)
SELECT {KEYCOLS}, model_class,
  CASE WHEN n < 60 THEN 'NEUTRAL' WHEN model_class = 1 THEN 'BULLISH' WHEN model_class = -1 THEN 'BEARISH'
       ELSE 'NEUTRAL' END AS ai_signal,
  gated,
  CAST(CASE WHEN (gated = 1 AND slope_20 < -({LIMIT})) OR (gated = -1 AND slope_20 > {LIMIT}) THEN 0
       ELSE gated END AS INTEGER) AS gated_backtest,
  CAST(CASE WHEN (gated = 1 AND slope_20 > -({LIMIT})) OR (gated = -1 AND slope_20 < {LIMIT}) THEN gated
       ELSE 0 END AS INTEGER) AS gated_live
FROM g1"""


# --- backtests ------------------------------------------------------------------------------


def _split(src: str, cond: str) -> str:
    return f"""
x0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m,
              count(*) OVER (PARTITION BY symbol, tf) AS rows_ FROM {src} WHERE {cond}),
x1 AS (SELECT *, m - CAST(floor(rows_ * 0.8) AS BIGINT) AS t, {PROBS} FROM x0),
test AS (SELECT * FROM x1 WHERE t >= 0)"""


def _tw(frame: str = "") -> str:
    return f"OVER (PARTITION BY symbol, tf ORDER BY t {frame})"


def _equity(src: str) -> str:
    return f"""
eq AS (SELECT *, product(1.0 + strat_ret) {_tw('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS equity,
              product(1.0 + ret) {_tw('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS equity_bh
       FROM {src})"""


V11_OK = "label_valid AND " + " AND ".join(f"{c} IS NOT NULL" for c in V11_COLS)

B2B = f"""
b0 AS (SELECT *, CAST({_gate(0.54)} AS INTEGER) AS prediction FROM test),
b1 AS (SELECT *, CAST(CASE WHEN (prediction = 1 AND slope_20 < -({LIMIT}))
                         OR (prediction = -1 AND slope_20 > {LIMIT}) THEN 0 ELSE prediction END AS INTEGER) AS signal
       FROM b0),
b2 AS (SELECT *, {tdiv(f'lead(close, 1) {_tw()} - close', 'close')} AS ret,
              CASE WHEN t = 0 THEN 0 ELSE lag(signal, 1) {_tw()} END AS prev_pos FROM b1),
b3 AS (SELECT *, CASE WHEN signal <> prev_pos AND signal <> 0 THEN 0.0004 ELSE 0.0 END AS cost FROM b2
       WHERE ret IS NOT NULL),
b4 AS (SELECT *, CASE WHEN signal = 1 THEN ret - cost WHEN signal = -1 THEN -ret - cost ELSE 0.0 END AS strat_ret
       FROM b3)"""

SQL["backtest_bar_to_bar"] = _li(barrier_ctes("v11"), _split("feat", V11_OK), B2B, _equity("b4")) + f"""
SELECT {KEYCOLS}, t, prediction, signal, {rnd('ret')} AS ret, {rnd('cost')} AS cost, {rnd('strat_ret')} AS strat_ret,
  {rnd('equity')} AS equity, {rnd('equity_bh')} AS equity_bh FROM eq"""

V10_OK = "label_valid AND " + " AND ".join(f"{c} IS NOT NULL" for c in V10_COLS)
B2B_V10 = B2B.replace(_gate(0.54), _gate(0.52)).replace("slope_20", "slope_30").replace(f"({LIMIT})", "(0.0001)").replace(f"> {LIMIT}", "> 0.0001")
SQL["backtest_v10"] = _li(barrier_ctes("v10"), _split("feat", V10_OK), B2B_V10, _equity("b4")) + f"""
SELECT {KEYCOLS}, t, prediction, signal, {rnd('ret')} AS ret, {rnd('cost')} AS cost, {rnd('strat_ret')} AS strat_ret,
  {rnd('equity')} AS equity, {rnd('equity_bh')} AS equity_bh FROM eq"""
SQL["backtest_tables"] = f"SELECT symbol, tf, time, t, ret, strat_ret, equity, equity_bh, 'v11' AS run_id FROM ({SQL['backtest_bar_to_bar']})"
SQL["log_written"] = """
SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  count(*) AS n_lines FROM events GROUP BY ALL"""

SQL["backtest_summary"] = _li(barrier_ctes("v11"), _split("feat", V11_OK), B2B) + f"""
, perf AS (SELECT symbol, tf, product(1.0 + strat_ret) - 1.0 AS strategy_return,
                  product(1.0 + ret) - 1.0 AS buy_hold_return, count(*) AS n_returns FROM b4 GROUP BY symbol, tf),
cnt AS (SELECT symbol, tf, count(*) AS test_size, count_if(prediction = 1) AS n_buy,
               count_if(prediction = 0) AS n_hold, count_if(prediction = -1) AS n_sell FROM b1 GROUP BY symbol, tf)
SELECT c.symbol, c.tf, test_size, n_buy, n_hold, n_sell, {rnd('strategy_return')} AS strategy_return,
  {rnd('buy_hold_return')} AS buy_hold_return, n_returns
FROM cnt c LEFT JOIN perf p ON c.symbol = p.symbol AND c.tf = p.tf"""

M25_OK = " AND ".join(f"{c} IS NOT NULL" for c in M25_COLS)

SQL["backtest_horizon"] = _li(momentum_ctes(), _split("feat", M25_OK), f"""
h0 AS (SELECT *, CAST({ARGMAX} AS INTEGER) AS signal, {tdiv(f'lead(close, 5) {_tw()} - close', 'close')} AS ret FROM test
       JOIN (SELECT symbol AS s_, tf AS tf_, n AS n_, close FROM nb) c ON c.s_ = symbol AND c.tf_ = tf AND c.n_ = n),
h1 AS (SELECT *, CASE WHEN signal = 1 THEN ret WHEN signal = -1 THEN -ret ELSE 0.0 END AS strat_ret FROM h0
       WHERE ret IS NOT NULL)""", _equity("h1")) + f"""
SELECT {KEYCOLS}, t, signal, {rnd('ret')} AS ret, {rnd('strat_ret')} AS strat_ret, {rnd('equity')} AS equity,
  {rnd('equity_bh')} AS equity_bh FROM eq"""


def _first_touch_close(side: int) -> str:
    cases = []
    for j in range(1, 11):
        nxt = f"lead(close, {j}) {_tw()}"
        if side == 1:
            cases.append(f"WHEN {nxt} >= close * 1.015 THEN 1 WHEN {nxt} <= close * (1 - 0.008) THEN -1")
        else:
            cases.append(f"WHEN {nxt} <= close * (1 - 0.015) THEN 1 WHEN {nxt} >= close * (1 + 0.008) THEN -1")
    return "CASE " + " ".join(cases) + " ELSE 0 END"


SQL["backtest_tp_sl"] = _li(momentum_ctes(), _split("feat", M25_OK), f"""
k0 AS (SELECT t0.*, c.close FROM test t0 JOIN (SELECT symbol AS s_, tf AS tf_, n AS n_, close FROM nb) c
       ON c.s_ = t0.symbol AND c.tf_ = t0.tf AND c.n_ = t0.n),
k1 AS (SELECT *, CAST({_gate(0.40)} AS INTEGER) AS signal,
         coalesce(lead(close, 10) {_tw()}, last_value(close) {_tw('ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING')}) AS exit_,
         coalesce(lead(close, 5) {_tw()}, last_value(close) {_tw('ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING')}) AS hold_,
         lead(close, 5) {_tw()} IS NOT NULL AS keep_,
         {_first_touch_close(1)} AS hit_long, {_first_touch_close(-1)} AS hit_short
       FROM k0),
k2 AS (SELECT *, {tdiv('hold_ - close', 'close')} AS ret,
         CASE WHEN signal = 0 THEN 0.0
              WHEN (CASE WHEN signal = 1 THEN hit_long ELSE hit_short END) = 1 THEN 0.015
              WHEN (CASE WHEN signal = 1 THEN hit_long ELSE hit_short END) = -1 THEN -0.008
              WHEN signal = 1 THEN {tdiv('exit_ - close', 'close')} ELSE {tdiv('close - exit_', 'close')} END AS strat_ret
       FROM k1 WHERE keep_)""", _equity("k2")) + f"""
SELECT {KEYCOLS}, t, signal, {rnd('ret')} AS ret, {rnd('strat_ret')} AS strat_ret, {rnd('equity')} AS equity,
  {rnd('equity_bh')} AS equity_bh FROM eq"""


# --- account-side tables and rules ----------------------------------------------------------


def r2(x: str) -> str:
    return f"(CAST(floor(CAST({x} AS DOUBLE) * 100.0 + 0.5) AS DOUBLE) / 100.0)"


OBARS = ORDERS_BARS.replace("\nbars AS (", "\nobars AS (")
POSITIONS = OBARS + f""",
marks AS (SELECT symbol, arg_max(close, time) AS last_close FROM obars GROUP BY symbol),
pos0 AS (
  SELECT o_custkey AS account_id, o_orderkey AS ticket, o_orderpriority AS symbol,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS type,
    CAST(0.01 AS DOUBLE) * (1 + o_orderkey % 5) AS volume, o_totalprice AS price_open,
    CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS side, o_orderkey % 3 AS magic,
    o_orderdate AS opened_at, m.last_close AS price_current
  FROM orders LEFT JOIN marks m ON m.symbol = o_orderpriority),
pos AS (
  SELECT account_id, ticket, symbol, type, volume, price_open, price_current,
    coalesce(CASE WHEN ticket % 4 = 0 THEN {r2('price_open * (1.0 - side * 0.02)')} END, 0.0) AS sl,
    coalesce(CASE WHEN ticket % 6 = 0 THEN {r2('price_open * (1.0 + side * 0.03)')} END, 0.0) AS tp,
    {r2('(price_current - price_open) * side * volume')} AS profit, magic, opened_at
  FROM pos0),
acc AS (
  SELECT c_custkey AS account_id, c_acctbal AS balance, c_acctbal + coalesce(f.p, 0.0) AS equity,
         coalesce(f.p, 0.0) AS profit, c_acctbal + coalesce(f.p, 0.0) AS margin_free
  FROM customer LEFT JOIN (SELECT account_id, sum(profit) AS p FROM pos GROUP BY account_id) f
    ON f.account_id = c_custkey),
quotes AS (SELECT o_orderpriority AS symbol, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS bid,
                  arg_max(o_totalprice * 1.0002, (o_orderdate, o_orderkey)) AS ask
           FROM orders GROUP BY o_orderpriority),
oinfo AS (SELECT DISTINCT symbol, 0.01 AS point, 2 AS digits, 0.01 AS volume_min, 50.0 AS volume_max FROM obars),
book AS (
  SELECT account_id, symbol, count_if(type = 'BUY') AS n_buy, count_if(type = 'SELL') AS n_sell,
    coalesce(min(CASE WHEN type = 'BUY' THEN price_open END), 0.0) AS buy_anchor,
    coalesce(max(CASE WHEN type = 'SELL' THEN price_open END), 0.0) AS sell_anchor,
    count(*) AS grid_count
  FROM pos GROUP BY account_id, symbol)"""

def trades_sql(symbol: str = "l_returnflag", source: str = "lineitem") -> str:
    return f"""
trades AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, l_shipdate AS closed_at, l_orderkey AS order_key, l_linenumber AS line_number,
         l_partkey AS part_key, {r2('(l_discount - 0.05) * l_extendedprice')} AS profit FROM {source}),
last_ok AS (SELECT symbol, max((closed_at, order_key, line_number, part_key)) AS reset_k FROM trades
            WHERE profit >= 0 GROUP BY symbol),
streaks AS (
  SELECT t.symbol, count(*) AS n_closed, count_if(profit < 0) AS n_losses,
    count_if(profit < 0 AND (l.reset_k IS NULL OR (closed_at, order_key, line_number, part_key) > l.reset_k))
      AS loss_streak
  FROM trades t LEFT JOIN last_ok l ON l.symbol = t.symbol GROUP BY t.symbol)"""


TRADES = trades_sql()
ORDER_TRADES = trades_sql("o_orderpriority", "lineitem JOIN orders ON l_orderkey = o_orderkey")
LOT = "round_even(least(greatest(least(0.01 * pow(1.5, CAST({0} AS DOUBLE)), 1.0), 0.01), 50.0), 2)"

SQL["position_book"] = with_ctes(POSITIONS) + f"""
SELECT account_id, symbol, n_buy, n_sell, {rnd('buy_anchor')} AS buy_anchor, {rnd('sell_anchor')} AS sell_anchor,
  grid_count FROM book"""

SQL["loss_streaks"] = with_ctes(TRADES) + "\nSELECT symbol, n_closed, n_losses, loss_streak FROM streaks"

SQL["lot_size"] = with_ctes(TRADES) + f"""
SELECT symbol, loss_streak,
  {rnd('round_even(least(greatest(least(0.01 * pow(1.5, CAST(loss_streak AS DOUBLE)), 1.0), 0.01), 50.0), 2)')} AS lot
FROM streaks"""

SQL["loss_streaks_by_supplier"] = with_ctes(trades_sql("l_suppkey")) + "\nSELECT symbol, n_closed, n_losses, loss_streak FROM streaks"
SQL["lot_size_by_supplier"] = with_ctes(trades_sql("l_suppkey")) + f"\nSELECT symbol, loss_streak, {rnd(LOT.format('loss_streak'))} AS lot FROM streaks"

SQL["max_risk"] = with_ctes(POSITIONS) + f"""
SELECT account_id, {rnd('balance')} AS balance, {rnd('equity')} AS equity, {rnd('profit')} AS profit,
  {rnd('margin_free')} AS margin_free, {rnd('balance - equity')} AS floating_loss,
  {rnd('equity - balance')} AS floating_profit, coalesce(balance - equity >= balance * 0.1, TRUE) AS risk_stop
FROM acc"""

SQL["trailing_points"] = with_ctes(POSITIONS) + f"""
, tp0 AS (
  SELECT p.*, q.bid, q.ask, i.point, i.digits,
    CASE WHEN p.type = 'BUY' THEN q.bid ELSE q.ask END AS px FROM pos p
  LEFT JOIN quotes q ON q.symbol = p.symbol LEFT JOIN oinfo i ON i.symbol = p.symbol),
tp1 AS (
  SELECT *, CAST(trunc((CASE WHEN type = 'BUY' THEN px - price_open ELSE price_open - px END) / point) AS BIGINT) AS pts,
    CASE WHEN type = 'BUY' THEN px - 300.0 * point ELSE px + 300.0 * point END AS nsl FROM tp0),
tp2 AS (
  SELECT *, coalesce(pts >= 300 AND (sl = 0 OR (type = 'BUY' AND nsl > sl) OR (type <> 'BUY' AND nsl < sl)), FALSE) AS mv
  FROM tp1)
SELECT account_id, ticket, symbol, type, {rnd('px')} AS price_current, pts AS gain_points,
  {rnd('CASE WHEN mv THEN round_even(nsl * pow(10.0, digits), 0) / pow(10.0, digits) END')} AS new_sl,
  {rnd('CASE WHEN mv THEN CASE WHEN tp > 0 THEN round_even(tp * pow(10.0, digits), 0) / pow(10.0, digits) ELSE 0.0 END END')} AS new_tp,
  mv AS move_sl
FROM tp2"""

# the tightest stop of all quotes that reach the distance, and tighten the stored one
SQL["stream_trailing_stops"] = with_ctes(POSITIONS) + f"""
, best AS (
  SELECT o_orderpriority AS symbol, max(o_totalprice) AS bid, min(o_totalprice * 1.0002) AS ask FROM orders GROUP BY o_orderpriority),
ts0 AS (
  SELECT p.*, i.digits, i.point, CASE WHEN p.type = 'BUY' THEN q.bid ELSE q.ask END AS px FROM pos p
  LEFT JOIN best q ON q.symbol = p.symbol LEFT JOIN oinfo i ON i.symbol = p.symbol),
ts1 AS (
  SELECT *, CASE WHEN type = 'BUY' THEN px - 300.0 * point ELSE px + 300.0 * point END AS nsl,
    trunc((CASE WHEN type = 'BUY' THEN px - price_open ELSE price_open - px END) / point) >= 300 AS reached FROM ts0),
ts2 AS (
  SELECT *, coalesce(reached AND (sl = 0 OR (type = 'BUY' AND nsl > sl) OR (type <> 'BUY' AND nsl < sl)), FALSE) AS mv FROM ts1)
SELECT account_id, ticket, symbol, type,
  {rnd('CASE WHEN mv THEN round_even(nsl * pow(10.0, digits), 0) / pow(10.0, digits) WHEN sl <> 0 THEN sl END')} AS stop, mv AS move_sl
FROM ts2"""

SQL["class_distribution"] = _li(barrier_ctes("v11")) + f"""
SELECT symbol, tf, label, count(*) AS n_rows FROM feat WHERE {V11_OK} GROUP BY symbol, tf, label"""


def _cm() -> str:
    names = {-1: "sell", 0: "hold", 1: "buy"}
    cols = [f"count_if(label = {a} AND pred = {b}) AS cm_{names[a]}_{names[b]}" for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return ", ".join(cols)


def _metrics() -> str:
    names = {-1: "sell", 0: "hold", 1: "buy"}
    parts, f1s = [], []
    for c in (-1, 0, 1):
        nc = names[c]
        tp = f"cm_{nc}_{nc}"
        sup = "(" + " + ".join(f"cm_{nc}_{names[b]}" for b in (-1, 0, 1)) + ")"
        prd = "(" + " + ".join(f"cm_{names[a]}_{nc}" for a in (-1, 0, 1)) + ")"
        prec = f"(CASE WHEN {prd} > 0 THEN {tp} / {prd} ELSE 0.0 END)"
        rec = f"(CASE WHEN {sup} > 0 THEN {tp} / {sup} ELSE 0.0 END)"
        f1 = f"(CASE WHEN {prec} + {rec} > 0 THEN 2.0 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END)"
        f1s.append(f1)
        parts += [f"{rnd(prec)} AS precision_{nc}", f"{rnd(rec)} AS recall_{nc}", f"{rnd(f1)} AS f1_{nc}",
                  f"{sup} AS support_{nc}"]
    acc = "(" + " + ".join(f"cm_{names[c]}_{names[c]}" for c in (-1, 0, 1)) + ") / n"
    parts += [f"{rnd(acc)} AS accuracy", f"{rnd('(' + ' + '.join(f1s) + ') / 3.0')} AS macro_f1"]
    return ", ".join(parts)


CM_COLS = ", ".join(f"cm_{a}_{b}" for a in ("sell", "hold", "buy") for b in ("sell", "hold", "buy"))

SQL["confusion_metrics"] = _li(barrier_ctes("v11")) + f"""
, cmx AS (SELECT *, {PROBS} FROM feat WHERE {V11_OK}),
cmy AS (SELECT symbol, tf, label, CAST({ARGMAX} AS INTEGER) AS pred FROM cmx),
cmz AS (SELECT symbol, tf, count(*) AS n, {_cm()} FROM cmy GROUP BY symbol, tf)
SELECT symbol, tf, n, {CM_COLS}, {_metrics()} FROM cmz"""

SQL["asof_h1_to_m15"] = with_ctes(events_bars("M15", 900, "m15"), events_bars("H1", 3600, "bars"), NUMBERED,
                                  ta_state()) + f"""
, h1 AS (SELECT symbol, time, {lag(IND['rsi_14'])} AS h1_rsi, {lag('close')} AS h1_close FROM ta)
SELECT m.symbol, m.tf, m.time, {rnd('m.close')} AS close,
  CASE WHEN m.time - h.time <= INTERVAL 15 MINUTE THEN h.time END AS h1_time,
  {rnd("coalesce(CASE WHEN m.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_rsi END, 50.0)")} AS h1_rsi,
  {rnd("coalesce(CASE WHEN m.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_close END, 0.0)")} AS h1_close
FROM m15 m ASOF LEFT JOIN h1 h ON m.symbol = h.symbol AND m.time >= h.time"""

SQL["event_log_tail"] = """
SELECT ts, event_type AS symbol,
  CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
  CASE WHEN event_type = 'error' THEN '❌ ' || event_type WHEN event_type = 'purchase' THEN '✅ ' || event_type
       ELSE event_type END AS msg,
  CAST(ts AS DATE) AS date
FROM events ORDER BY ts DESC, symbol, msg LIMIT 50"""

SQL["close_all"] = with_ctes(POSITIONS) + f"""
, ca AS (SELECT b.account_id, b.symbol, a.balance, a.equity - a.balance AS fp FROM book b JOIN acc a USING (account_id))
SELECT account_id, symbol, {rnd('fp')} AS floating_profit,
  (fp >= balance * 0.001) OR (fp >= 5.0) OR coalesce(fp > 0 AND (fp - fp) / fp * 100.0 >= 20.0, FALSE) AS close_all,
  CASE WHEN fp >= balance * 0.001 THEN 'profit ' || {ftxt('fp', 2)} || ' >= ' || {ftxt('balance * 0.001', 2)}
       WHEN fp >= 5.0 THEN 'profit ' || {ftxt('fp', 2)} || ' >= $5.0'
       ELSE '' END AS reason
FROM ca"""

# every account with every configured symbol that has a quote; written from the rules, not from a book of positions
SLOTS = """
slots AS (
  SELECT a.account_id, q.symbol, a.balance, a.equity, q.bid, q.ask,
    (SELECT count(*) FROM pos p WHERE p.account_id = a.account_id AND p.symbol = q.symbol AND p.type = 'BUY') AS n_buy,
    (SELECT count(*) FROM pos p WHERE p.account_id = a.account_id AND p.symbol = q.symbol AND p.type = 'SELL') AS n_sell,
    (SELECT min(price_open) FROM pos p WHERE p.account_id = a.account_id AND p.symbol = q.symbol AND p.type = 'BUY') AS low_buy,
    (SELECT max(price_open) FROM pos p WHERE p.account_id = a.account_id AND p.symbol = q.symbol AND p.type = 'SELL') AS high_sell,
    CASE ascii(q.symbol) % 3 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS side
  FROM acc a, quotes q
  WHERE q.symbol IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))"""
_G = """
, g AS (
  SELECT *, 'BUY' AS side_, ask AS price, coalesce(low_buy, 0.0) AS anchor, n_buy AS grid_level, 1.0 AS dir FROM slots
  UNION ALL SELECT *, 'SELL', bid, coalesce(high_sell, 0.0), n_sell, -1.0 FROM slots),
g2 AS (SELECT *, abs(price - anchor) / 0.01 AS dist,
              n_buy + n_sell < 10 AND (anchor = 0 OR abs(price - anchor) / 0.01 >= 300.0) AS open_grid FROM g)"""
SQL["grid_trigger"] = with_ctes(POSITIONS, SLOTS) + _G + f"""
SELECT account_id, symbol, side_ AS side, {rnd('price')} AS price, {rnd('anchor')} AS anchor, {rnd('dist')} AS distance_points,
  open_grid, grid_level FROM g2"""


def _cents(x: str) -> str:
    return f"round_even(({x}) * pow(10.0, 2), 0) / pow(10.0, 2)"


SQL["grid_intents"] = with_ctes(POSITIONS, SLOTS) + _G + f"""
SELECT account_id, symbol, lower(side_) AS action, {rnd(LOT.format('grid_level'))} AS volume, {rnd('price')} AS price,
  {rnd(_cents('price - dir * 20.0 * 0.01 * 100.0'))} AS sl, {rnd(_cents('price + dir * 40.0 * 0.01 * 100.0'))} AS tp
FROM g2 WHERE open_grid AND balance - equity < balance * 0.1"""

SQL["flagship"] = _li(ta_state(), f"""
fl0 AS (SELECT *, CASE WHEN n >= 99 AND {IND['ema_12']} > {IND['ema_26']} THEN 1
                       WHEN n >= 99 AND {IND['ema_12']} < {IND['ema_26']} THEN -1 ELSE 0 END AS signal,
               row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m,
               count(*) OVER (PARTITION BY symbol, tf) AS rows_ FROM ta),
test AS (SELECT *, m - CAST(floor(rows_ * 0.8) AS BIGINT) AS t FROM fl0 WHERE m >= floor(rows_ * 0.8)),
b2 AS (SELECT *, {tdiv(f'lead(close, 1) {_tw()} - close', 'close')} AS ret,
              CASE WHEN t = 0 THEN 0 ELSE lag(signal, 1) {_tw()} END AS prev_pos FROM test),
b3 AS (SELECT *, CASE WHEN signal <> prev_pos AND signal <> 0 THEN 0.0004 ELSE 0.0 END AS cost FROM b2
       WHERE ret IS NOT NULL),
b4 AS (SELECT *, CASE WHEN signal = 1 THEN ret - cost WHEN signal = -1 THEN -ret - cost ELSE 0.0 END AS strat_ret
       FROM b3)""") + f"""
, perf AS (SELECT symbol, tf, product(1.0 + strat_ret) - 1.0 AS strategy_return,
                  product(1.0 + ret) - 1.0 AS buy_hold_return, count(*) AS n_returns FROM b4 GROUP BY symbol, tf),
cnt AS (SELECT symbol, tf, count(*) AS test_size, count_if(signal = 1) AS n_buy,
               count_if(signal = 0) AS n_hold, count_if(signal = -1) AS n_sell FROM test GROUP BY symbol, tf)
SELECT c.symbol, c.tf, test_size, n_buy, n_hold, n_sell, {rnd('strategy_return')} AS strategy_return,
  {rnd('buy_hold_return')} AS buy_hold_return, n_returns
FROM cnt c LEFT JOIN perf p ON c.symbol = p.symbol AND c.tf = p.tf"""

SQL["stream_bars_m15"] = with_ctes(events_bars("M15", 900)) + f"""
SELECT {BARS_OUT} FROM bars
WHERE time + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

SQL["atr_trailing"] = with_ctes(ORDERS_BARS, NUMBERED, ta_state(), POSITIONS) + f"""
, lastbar AS (SELECT symbol, arg_max(close, n) AS c, arg_max({IND['atr']}, n) AS atr FROM ta GROUP BY symbol),
at0 AS (SELECT p.*, l.c, l.atr,
          round_even(CASE WHEN p.type = 'BUY' THEN l.c - l.atr * 1.5 ELSE l.c + l.atr * 1.5 END, 3) AS nsl
        FROM pos p LEFT JOIN lastbar l ON l.symbol = p.symbol),
at1 AS (SELECT *, coalesce(CASE WHEN type = 'BUY' THEN nsl > sl + atr * 0.2
                                ELSE sl = 0 OR nsl < sl - atr * 0.2 END, FALSE) AS mv FROM at0)
SELECT account_id, ticket, symbol, type, {rnd('CASE WHEN mv THEN nsl END')} AS new_sl, mv AS move_sl FROM at1"""

SQL["atr_stop_path"] = _li(ta_state(), f"""
st AS (SELECT symbol, tf, n, atr_ AS atr, s.side, round_even(close - s.dir * atr_ * 1.5, 3) AS cand
       FROM (SELECT *, {IND['atr']} AS atr_ FROM ta) t, (VALUES ('BUY', 1.0), ('SELL', -1.0)) s(side, dir) WHERE atr_ IS NOT NULL),
path AS (
  SELECT symbol, tf, side, n, CASE WHEN side = 'SELL' OR cand > atr * 0.2 THEN cand ELSE 0.0 END AS stop,
         side = 'SELL' OR cand > atr * 0.2 AS moved FROM st WHERE n = 14
  UNION ALL
  SELECT s.symbol, s.tf, s.side, s.n, CASE WHEN mv THEN cand ELSE stop0 END, mv FROM (
    SELECT s.*, p.stop AS stop0,
           CASE s.side WHEN 'BUY' THEN s.cand > p.stop + s.atr * 0.2 ELSE p.stop = 0 OR s.cand < p.stop - s.atr * 0.2 END AS mv
    FROM path p JOIN st s ON s.symbol = p.symbol AND s.tf = p.tf AND s.side = p.side AND s.n = p.n + 1) s)""") + f"""
SELECT symbol, tf, side, n, {rnd('stop')} AS stop, moved FROM path"""
SQL["atr_trailing_walk"] = SQL["atr_trailing"].replace(
    "FROM pos p LEFT JOIN lastbar", "FROM (SELECT * REPLACE (price_current * (1.0 + (ticket % 13 - 6)::DOUBLE / 3.0) AS sl) FROM pos) p LEFT JOIN lastbar")
SQL["close_rules_walk"] = with_ctes(POSITIONS) + f"""
, cr AS (SELECT * REPLACE (CAST(ticket % 61 - 30 AS DOUBLE) AS profit),
                CASE ascii(symbol) % 3 WHEN 1 THEN 'BULLISH' WHEN 2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sig FROM pos)
SELECT account_id, ticket, symbol, type, {rnd('profit')} AS profit, sig AS signal,
  profit >= 10 OR profit <= -20 OR (profit > 0 AND ((type = 'BUY' AND sig = 'BEARISH') OR (type = 'SELL' AND sig = 'BULLISH'))) AS close,
  CASE WHEN profit >= 10 THEN 'take_profit' WHEN profit <= -20 THEN 'stop_loss'
       WHEN profit > 0 AND ((type = 'BUY' AND sig = 'BEARISH') OR (type = 'SELL' AND sig = 'BULLISH')) THEN 'signal_reversal'
       ELSE '' END AS reason FROM cr"""

SQL["close_rules"] = with_ctes(ORDERS_BARS, NUMBERED, _signals_cte(), POSITIONS) + f"""
, lastsig AS (SELECT symbol, arg_max(combined, n) AS sig FROM sig GROUP BY symbol),
cr AS (SELECT p.*, l.sig, (profit >= 10.0 OR profit <= -20.0) AS by_level FROM pos p
       LEFT JOIN lastsig l ON l.symbol = p.symbol),
cr2 AS (SELECT *, NOT by_level AND profit > 0 AND coalesce((type = 'BUY' AND sig = 'BEARISH')
                  OR (type = 'SELL' AND sig = 'BULLISH'), FALSE) AS by_signal FROM cr)
SELECT account_id, ticket, symbol, type, {rnd('profit')} AS profit, sig AS signal, by_level OR by_signal AS close,
  CASE WHEN by_level AND profit >= 10.0 THEN 'take_profit' WHEN by_level THEN 'stop_loss'
       WHEN by_signal THEN 'signal_reversal' ELSE '' END AS reason
FROM cr2"""

SQL["order_intents"] = with_ctes(POSITIONS, SLOTS, ORDER_TRADES) + f"""
, o1 AS (SELECT s.*, coalesce(t.loss_streak, 0) AS streak, balance - equity >= balance * 0.1 AS stop,
                CASE side WHEN 1 THEN ask ELSE bid END AS px
         FROM slots s LEFT JOIN streaks t ON t.symbol = s.symbol
         WHERE (side = 1 AND n_buy = 0) OR (side = -1 AND n_sell = 0))
SELECT account_id, symbol, CASE WHEN stop THEN 'close_all' WHEN side = 1 THEN 'buy' ELSE 'sell' END AS action,
  {rnd(f"CASE WHEN NOT stop THEN {LOT.format('streak')} END")} AS volume,
  {rnd('CASE WHEN NOT stop THEN px END')} AS price,
  {rnd(f"CASE WHEN NOT stop THEN {_cents('px - side * 20.0 * 0.01 * 100.0')} END")} AS sl,
  {rnd(f"CASE WHEN NOT stop THEN {_cents('px + side * 40.0 * 0.01 * 100.0')} END")} AS tp,
  CAST(0 AS BIGINT) AS magic,
  CASE WHEN stop THEN 'risk stop' WHEN side = 1 THEN 'auto BULLISH' ELSE 'auto BEARISH' END AS comment
FROM o1"""


# --- 30-column multi-timeframe set ----------------------------------------------------------

S30_COLS = ["h1_slope", "h1_slope_accel", "london_session", "ny_session", "ny_volatility", *M25_COLS]
HTF_OUT = ["price_to_ema200_h1", "htf_slope", "m15_slope", "h1_macd", "h1_rsi", "h1_rsi_slope", "h1_adx",
           "h1_adx_slope", "h1_trend", "m15_trend", "trend_alignment"]


def _hw(frame: str = "") -> str:
    return f"OVER (PARTITION BY symbol, tf ORDER BY n {frame})"


def session30_sql() -> str:
    hbars = events_bars("H1", 3600, "hbars")
    hnb = "\nhnb AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time) - 1 AS n FROM hbars)"
    return with_ctes(events_bars("M15", 900), NUMBERED, momentum_ctes(), f"""
s1 AS (SELECT f.* EXCLUDE (label, label_valid), m.e12v FROM feat f JOIN m1 m USING (symbol, tf, n))""", f"""
s2 AS (SELECT *, ema26_slope - lag(ema26_slope) {_hw()} AS h1_slope_accel,
         coalesce({tdiv(f"lag(e12v, 1) {_hw()} - lag(e12v, 2) {_hw()}", f"lag(e12v, 1) {_hw()}")} * 100.0, 0.0) AS m15_slope,
         CASE WHEN hour(time) >= 8 AND hour(time) < 16 THEN 1.0 ELSE 0.0 END AS london_session,
         CASE WHEN hour(time) >= 13 AND hour(time) < 21 THEN 1.0 ELSE 0.0 END AS ny_session
       FROM s1)""", f"""
s3 AS (SELECT s2.*, ema26_slope AS h1_slope, ny_session * volatility AS ny_volatility, nb.open AS o_, nb.high AS hi_,
         nb.low AS lo_, nb.close AS close_, nb.tick_volume AS tv_ FROM s2 JOIN nb USING (symbol, tf, n))""",
        hbars, hnb, ta_state("hnb", "hta"), f"""
h0 AS (SELECT symbol, tf, n, time, {IND['ema_200']} AS e200, {IND['macd']} AS macdv, {IND['rsi_14']} AS rsiv,
          {IND['adx']} AS adxv FROM hta)""", f"""
h1a AS (SELECT *, {tdiv(f"e200 - lag(e200) {_hw()}", f"lag(e200) {_hw()}")} * 100.0 AS sl,
          rsiv - lag(rsiv) {_hw()} AS rs, adxv - lag(adxv) {_hw()} AS ads FROM h0)""", f"""
h1b AS (SELECT symbol, time, lag(e200) {_hw()} AS h1_ema200, lag(macdv) {_hw()} AS h1_macd_raw,
          lag(rsiv) {_hw()} AS h1_rsi_raw, lag(adxv) {_hw()} AS h1_adx_raw, lag(sl) {_hw()} AS h1_slope_raw,
          lag(rs) {_hw()} AS h1_rsi_slope_raw, lag(ads) {_hw()} AS h1_adx_slope_raw FROM h1a)""", f"""
j AS (SELECT s.*, CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_ema200 END AS he,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_macd_raw END AS hm,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_rsi_raw END AS hr,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_adx_raw END AS ha,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_slope_raw END AS hs,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_rsi_slope_raw END AS hrs,
         CASE WHEN s.time - h.time <= INTERVAL 15 MINUTE THEN h.h1_adx_slope_raw END AS has
       FROM s3 s ASOF LEFT JOIN h1b h ON s.symbol = h.symbol AND s.time >= h.time)""", f"""
lbl AS (SELECT symbol, tf, n, {_triple_barrier()} AS label FROM nb)""", f"""
fin AS (SELECT j.*, l.label,
          coalesce({tdiv('close_ - he', 'close_')} * 100.0, 0.0) AS price_to_ema200_h1, coalesce(hs, 0.0) AS htf_slope,
          coalesce({tdiv('hm', 'close_')} * 1000.0, 0.0) AS h1_macd, coalesce(hr, 50.0) AS h1_rsi,
          coalesce(hrs, 0.0) AS h1_rsi_slope, coalesce(ha, 25.0) AS h1_adx, coalesce(has, 0.0) AS h1_adx_slope,
          CAST(CASE WHEN coalesce(hs, 0.0) > 0 THEN 1 ELSE -1 END AS INTEGER) AS h1_trend,
          CAST(CASE WHEN m15_slope > 0 THEN 1 ELSE -1 END AS INTEGER) AS m15_trend
        FROM j JOIN lbl l USING (symbol, tf, n))""") + f"""
SELECT {KEYCOLS}, {', '.join(c if c in INT_COLS else f'{rnd(c)} AS {c}' for c in S30_COLS)},
  {', '.join(c if c in ('h1_trend', 'm15_trend') else f'{rnd(c)} AS {c}' for c in HTF_OUT if c != 'trend_alignment')},
  {rnd('CASE WHEN h1_trend = m15_trend THEN 1.0 ELSE -1.0 END')} AS trend_alignment, label
FROM fin WHERE {' AND '.join(f'{c} IS NOT NULL' for c in M25_COLS + ['h1_slope_accel'])}"""


SQL["features_session30"] = session30_sql()

SQL["reversal_intents"] = with_ctes(ORDERS_BARS, NUMBERED, ta_state(), POSITIONS, SLOTS) + f"""
, lastbar AS (SELECT symbol, arg_max(close, n) AS c, arg_max({IND['atr']}, n) AS atr FROM ta GROUP BY symbol),
held AS (SELECT account_id, symbol, arg_min(type, ticket) AS t_, arg_min(volume, ticket) AS v_, min(ticket) AS open_ticket
         FROM pos WHERE magic = 1 GROUP BY account_id, symbol),
f AS (SELECT s.account_id, s.symbol, s.side, s.bid, s.ask, h.v_, h.open_ticket, l.c, l.atr,
             CAST(CASE h.t_ WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS INTEGER) AS cur
      FROM slots s LEFT JOIN held h ON h.account_id = s.account_id AND h.symbol = s.symbol
      JOIN lastbar l ON l.symbol = s.symbol),
r AS (SELECT * FROM f WHERE side <> 0 AND side <> cur),
u AS (
  SELECT *, 0 AS step, 'close' AS action, CASE cur WHEN 1 THEN 'SELL' ELSE 'BUY' END AS side_, v_ AS volume,
         CASE cur WHEN 1 THEN bid ELSE ask END AS price, CAST(NULL AS DOUBLE) AS sl,
         CAST(NULL AS DOUBLE) AS tp FROM r WHERE cur <> 0
  UNION ALL
  SELECT *, CASE WHEN cur = 0 THEN 0 ELSE 1 END, 'open', CASE side WHEN 1 THEN 'BUY' ELSE 'SELL' END, 0.01, c,
         c - side * atr * 2.0, c + side * atr * 3.0 FROM r)
SELECT account_id, symbol, CAST(1 AS BIGINT) AS magic, CAST(side AS INTEGER) AS signal, cur AS current_side, open_ticket,
  CAST(step AS INTEGER) AS step, action, side_ AS side, {rnd('volume')} AS volume, {rnd('price')} AS price,
  {rnd('sl')} AS sl, {rnd('tp')} AS tp FROM u"""

SQL["ml_class_weights"] = _li(barrier_ctes("v11"), f"""
x0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m,
              count(*) OVER (PARTITION BY symbol, tf) AS rows_ FROM feat WHERE {V11_OK}),
train AS (SELECT * FROM x0 WHERE m < floor(rows_ * 0.8))""") + f"""
SELECT label, count(*) AS n_rows, {rnd('(SELECT count(*) FROM train) / (3.0 * count(*))')} AS weight FROM train GROUP BY label"""
SQL["ml_scaler_v11"] = SQL["ml_class_weights"].split("\nSELECT label, count(*)")[0] + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {rnd(f'avg(CAST({c} AS DOUBLE))')} AS mean, {rnd(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std FROM train"
    for c in V11_COLS)

# polls of (account, symbol) one after the other; a close sets the peak back to 0
PEAKS = f"""
polls AS (
  SELECT o_custkey AS account_id, o_orderpriority AS symbol, o_orderkey AS poll, c_acctbal AS balance,
    {r2('o_totalprice / 1000.0 - 150.0')} AS fp,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders JOIN customer ON c_custkey = o_custkey),
walk AS (
  SELECT account_id, symbol, poll, k, fp, CAST(NULL AS DOUBLE) AS seen, CAST('' AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS carried
  FROM (SELECT account_id, symbol, NULL::BIGINT AS poll, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS fp FROM polls GROUP BY account_id, symbol)
  UNION ALL
  SELECT account_id, symbol, poll, k, fp, seen, reason, CASE WHEN reason = '' THEN seen ELSE CAST(0 AS DOUBLE) END FROM (
    SELECT *, CASE WHEN by_level THEN 'profit'
                   WHEN seen > 0 AND (seen - fp) / seen * 100.0 >= 20.0 THEN 'pullback' ELSE '' END AS reason
    FROM (SELECT p.account_id, p.symbol, p.poll, p.k, p.fp, p.fp >= p.balance * 0.1 OR p.fp >= 250.0 AS by_level,
                 CASE WHEN p.fp >= p.balance * 0.1 OR p.fp >= 250.0 THEN w.carried
                      WHEN w.carried IS NULL OR p.fp > w.carried THEN p.fp ELSE w.carried END AS seen
          FROM walk w JOIN polls p ON p.account_id = w.account_id AND p.symbol = w.symbol AND p.k = w.k + 1)))"""
SQL["peak_profit"] = with_ctes(PEAKS) + f"""
SELECT account_id, symbol, poll, {rnd('fp')} AS floating_profit, {rnd('seen')} AS peak, reason <> '' AS close_all, reason
FROM walk WHERE k > 0"""
SQL["stream_peak_profit"] = SQL["peak_profit"]

SQL["stream_trade_state"] = with_ctes(trades_sql("l_suppkey")) + "\nSELECT symbol, loss_streak, n_closed AS n_seen FROM streaks"
SQL["trade_texts"] = with_ctes(TRADES) + f"""
SELECT order_key, line_number, part_key, CAST(sign(profit) AS INTEGER) AS sign, {ftxt('profit', 2)} AS profit_text,
  strftime(closed_at + to_seconds(CAST(order_key % 86400 AS BIGINT)), '%H:%M:%S') AS clock FROM trades"""

SQL["stream_indicators"] = with_ctes(events_bars("M15", 900, "allbars"), """
bars AS (SELECT * FROM allbars WHERE time + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""",
                                    NUMBERED, ta_state()) + f"""
SELECT symbol, tf, time, n, {rnd('close')} AS close, {rnd(IND['ema_12'])} AS ema_12, {rnd(IND['ema_26'])} AS ema_26,
  {rnd(IND['rsi_14'])} AS rsi_14 FROM ta"""

SQL["asof_trend_h1_to_m15"] = with_ctes(events_bars("M15", 900, "m15"), events_bars("H1", 3600, "bars"), NUMBERED,
                                        _signals_cte()) + f"""
SELECT m.symbol, m.tf, m.time, {rnd('m.close')} AS close, h.time AS trend_time,
  coalesce(h.trend, 'NEUTRAL') AS trend, coalesce(h.trend_reason, '') AS trend_reason
FROM m15 m ASOF LEFT JOIN (SELECT symbol, time, trend, trend_reason FROM sig) h
  ON m.symbol = h.symbol AND m.time + INTERVAL 15 MINUTE >= h.time + INTERVAL 1 HOUR"""

SQL["strategy_decisions"] = _li(_signals_cte()) + f"""
SELECT {KEYCOLS},
  CASE WHEN sideways THEN 'NEUTRAL'
       WHEN trend = 'BULLISH' AND combined = 'BULLISH' THEN 'BULLISH'
       WHEN trend = 'BEARISH' AND combined = 'BEARISH' THEN 'BEARISH' ELSE 'NEUTRAL' END AS decision
FROM sig WHERE symbol IN ('A', 'R')"""


def _ptxt(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {x} <> 0 THEN {ftxt(x, 5)} ELSE '' END"


SQL["status_snapshot"] = with_ctes(POSITIONS) + f"""
, cnt AS (SELECT account_id, count(*) AS np FROM pos GROUP BY account_id),
prow AS (
  SELECT account_id, ticket,
    CAST(to_json({{'ticket': ticket, 'symbol': symbol, 'type': type, 'volume': volume,
                   'price_open': {_ptxt('price_open')}, 'sl': {_ptxt('sl')}, 'tp': {_ptxt('tp')},
                   'profit': round_even(profit, 2)}}) AS VARCHAR) AS position_json
  FROM pos)
SELECT a.account_id, {rnd('round_even(a.balance, 2)')} AS balance, {rnd('round_even(a.equity, 2)')} AS equity,
  {rnd('round_even(a.profit, 2)')} AS profit, coalesce(c.np, 0) AS n_positions, p.ticket, p.position_json
FROM acc a LEFT JOIN cnt c ON c.account_id = a.account_id LEFT JOIN prow p ON p.account_id = a.account_id"""

# one file is one micro-batch
SQL["stream_position_decisions"] = f"SELECT *, CAST(0 AS INTEGER) AS batch_id FROM ({SQL['trailing_points']})"

SQL["model_signal_veto"] = _li(momentum_ctes(), f"""
v0 AS (SELECT symbol, tf, time, n, volatility, {PROBS} FROM feat WHERE {M25_OK})""", f"""
v1 AS (SELECT *, {sma('volatility', 20)} AS volatility_mean20, CAST({_gate(0.45)} AS INTEGER) AS gated FROM v0)""") + f"""
SELECT {KEYCOLS}, {rnd('volatility')} AS volatility, {rnd('volatility_mean20')} AS volatility_mean20, gated,
  CAST(CASE WHEN coalesce(volatility > 2.0 * volatility_mean20, FALSE) THEN 0 ELSE gated END AS INTEGER) AS signal
FROM v1"""


def _code_bars(code: str, seconds: int) -> str:
    return f"""
SELECT '{code}' AS code, CAST({seconds} AS BIGINT) AS bar_seconds, symbol, count(*) AS n_bars, CAST(sum(c) AS BIGINT) AS n_ticks FROM (
  SELECT event_type AS symbol, {bucket('ts', seconds)} AS t, count(*) AS c FROM events GROUP BY event_type, t)
GROUP BY symbol"""


SQL["bars_by_timeframe_code"] = "\nUNION ALL".join(
    _code_bars(c, s) for c, s in (("M5", 300), ("M30", 1800), ("H4", 14400), ("X7", 3600)))


# --- softmax boosted trees ------------------------------------------------------------------


def boosted(features: list[str], rounds: int = 4, depth: int = 3, eta: float = 0.3, bins: int = 16) -> str:
    """CTEs from ``brows`` (model, id, y in 0..2, w, the features) to ``bprobs`` (model, id, w, p_sell, p_hold, p_buy):
    bins of equal width over the rows of positive weight, then level by level histograms, splits and moved rows."""
    d = len(features)
    x = "[" + ", ".join(f"CAST({f} AS DOUBLE)" for f in features) + "]"
    out = [f"""
benough AS (SELECT model FROM brows WHERE w > 0 GROUP BY model HAVING count(*) >= 100),
bvals AS MATERIALIZED (SELECT model, id, y, w, unnest(range({d})) AS f, unnest({x}) AS v FROM brows WHERE model IN (SELECT model FROM benough)),
bends AS (SELECT model, f, min(v) AS lo, max(v) AS hi FROM bvals WHERE w > 0 GROUP BY model, f),
bcoded AS (SELECT a.*, len(list_filter(range(1, {bins}), lambda j: lo + (hi - lo) * CAST(j AS DOUBLE) / {bins}.0 < v)) AS bin
           FROM bvals a JOIN bends e ON a.model = e.model AND a.f = e.f),
b0_rows AS MATERIALIZED (SELECT model, id, y, w, list(bin ORDER BY f) AS b, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2
                         FROM bcoded GROUP BY model, id, y, w)"""]
    for r in range(rounds):
        out.append(f"""
b{r}_exp AS (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM b{r}_rows),
b{r}_p AS (SELECT model, id, y, w, b, k, CASE k WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2) AS p FROM b{r}_exp, (VALUES (0), (1), (2)) ks(k)),
b{r}_n0 AS MATERIALIZED (SELECT model, id, w, b, k, CAST(floor((p - CASE WHEN y = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * w * 1048576.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS g,
    CAST(floor(2.0::DOUBLE * p * (1.0::DOUBLE - p) * w * 1048576.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS h, 1 AS node, 0.0::DOUBLE AS v, true AS live FROM b{r}_p)""")
        for level in range(depth):
            n = f"b{r}_n{level}"
            out.append(f"""
{n}_h AS (SELECT model, k, node, f, bin, sum(g)::BIGINT AS g, sum(h)::BIGINT AS h
    FROM (SELECT model, k, node, g, h, unnest(range({d})) AS f, unnest(b) AS bin FROM {n} WHERE live AND w > 0) GROUP BY ALL),
{n}_c AS (SELECT model, k, node, f, bin, max(bin) OVER q AS last_, (sum(g) OVER o)::BIGINT AS gl_, (sum(h) OVER o)::BIGINT AS hl_,
    (sum(g) OVER q)::BIGINT AS g_, (sum(h) OVER q)::BIGINT AS h_ FROM {n}_h
    WINDOW q AS (PARTITION BY model, k, node, f), o AS (PARTITION BY model, k, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
{n}_u AS (SELECT model, k, node, f, bin, last_, gl_ / 1048576.0::DOUBLE AS gl, hl_ / 1048576.0::DOUBLE AS hl, (g_ - gl_) / 1048576.0::DOUBLE AS gr,
    (h_ - hl_) / 1048576.0::DOUBLE AS hr, g_ / 1048576.0::DOUBLE AS g, h_ / 1048576.0::DOUBLE AS h FROM {n}_c),
{n}_g AS (SELECT *, CASE WHEN bin < last_ AND hl >= 1 AND hr >= 1 THEN gl * gl / (hl + 1) + gr * gr / (hr + 1) - g * g / (h + 1) ELSE 0 END AS gain FROM {n}_u),
{n}_s AS MATERIALIZED (SELECT model, k, node, gain > 1e-9 AS split, f, bin AS cut, CASE WHEN gain > 1e-9 THEN -gl / (hl + 1) ELSE -g / (h + 1) END AS lv, -gr / (hr + 1) AS rv,
    CASE WHEN gain > 1e-9 THEN gain ELSE 0.0 END AS gain FROM {n}_g
    QUALIFY row_number() OVER (PARTITION BY model, k, node ORDER BY CASE WHEN gain > 1e-9 THEN gain ELSE 0 END DESC, f, bin) = 1),
b{r}_n{level + 1} AS MATERIALIZED (SELECT a.model, id, w, b, a.k, g, h,
    CASE WHEN live AND split THEN 2 * a.node + CASE WHEN b[f + 1] > cut THEN 1 ELSE 0 END ELSE a.node END AS node,
    CASE WHEN live AND split THEN CASE WHEN b[f + 1] > cut THEN rv ELSE lv END {'WHEN live THEN lv ' if level == 0 else ''}ELSE v END AS v,
    coalesce(live AND split, false) AS live
    FROM {n} a LEFT JOIN {n}_s s ON s.model = a.model AND s.k = a.k AND s.node = a.node)""")
        out.append(f"""
b{r}_v AS (SELECT model, id, max(v) FILTER (k = 0) AS v0, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2 FROM b{r}_n{depth} GROUP BY model, id),
b{r + 1}_rows AS MATERIALIZED (SELECT a.model, a.id, y, w, b, s0 + {eta}::DOUBLE * v0 AS s0, s1 + {eta}::DOUBLE * v1 AS s1, s2 + {eta}::DOUBLE * v2 AS s2
    FROM b{r}_rows a JOIN b{r}_v v ON v.model = a.model AND v.id = a.id)""")
    out.append(f"""
blast AS (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM b{rounds}_rows),
bprobs AS (SELECT model, id, w, e0 / (e0 + e1 + e2) AS p_sell, e1 / (e0 + e1 + e2) AS p_hold, e2 / (e0 + e1 + e2) AS p_buy FROM blast)""")
    return ",".join(out)


_P3 = f"CAST({ARGMAX} AS INTEGER) AS pred, {rnd('p_sell')} AS p_sell, {rnd('p_hold')} AS p_hold, {rnd('p_buy')} AS p_buy"
_V11_ROWS = f"""
x0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m, count(*) OVER (PARTITION BY symbol, tf) AS rows_ FROM feat WHERE {V11_OK}),
xs AS (SELECT *, CASE WHEN m >= floor(rows_ * 0.8) THEN m - CAST(floor(rows_ * 0.8) AS BIGINT) END AS t FROM x0)"""

SQL["ml_softmax_by_symbol"] = _li(barrier_ctes("v11"), _V11_ROWS, f"""
brows AS (SELECT symbol AS model, n AS id, label + 1 AS y, CASE WHEN t IS NULL THEN CASE label WHEN 0 THEN 0.5 WHEN 1 THEN 4.0 ELSE 2.0 END ELSE 0.0 END::DOUBLE AS w, * FROM xs)""",
    boosted(V11_COLS)) + f"""
SELECT symbol, tf, time, n, t, label, {_P3} FROM xs JOIN bprobs ON model = symbol AND id = n WHERE t IS NOT NULL"""

SQL["ml_importances"] = _li(barrier_ctes("v11"), _V11_ROWS, f"""
brows AS (SELECT symbol AS model, n AS id, label + 1 AS y, 1.0::DOUBLE AS w, * FROM xs WHERE t IS NULL)""",
    boosted(V11_COLS)) + f"""
, gains AS ({' UNION ALL '.join(f'SELECT model, f, gain FROM b{r}_n{v}_s WHERE split' for r in range(4) for v in range(3))}),
sums AS (SELECT model AS symbol, {V11_COLS}[f + 1] AS feature, sum(gain) AS gain FROM gains GROUP BY model, f)
SELECT symbol, feature, {rnd('gain / sum(gain) OVER (PARTITION BY symbol)')} AS importance FROM sums"""

_S4 = ["sma_10", "sma_30", "rsi_14", "price_change"]
SQL["ml_softmax_suppliers"] = with_ctes(LINEITEM_BARS.replace("l_returnflag AS symbol", "CAST(l_suppkey AS VARCHAR) AS symbol"), NUMBERED, ta_state(), f"""
s AS (SELECT symbol, tf, time, n, close, {sma('close', 10)} AS sma_10, {sma('close', 30)} AS sma_30,
        {IND['rsi_14']} AS rsi_14, {tdiv('close', lag('close'))} - 1.0 AS price_change, {tdiv(lead('close', 5) + ' - close', 'close')} AS ahead FROM ta),
x0 AS (SELECT *, CASE WHEN ahead > 0.002 THEN 1 WHEN ahead < -0.002 THEN -1 ELSE 0 END AS label,
        row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m, count(*) OVER (PARTITION BY symbol, tf) AS rows_
       FROM s WHERE sma_10 IS NOT NULL AND sma_30 IS NOT NULL AND rsi_14 IS NOT NULL AND price_change IS NOT NULL),
xs AS (SELECT *, CASE WHEN m >= floor(rows_ * 0.8) THEN m - CAST(floor(rows_ * 0.8) AS BIGINT) END AS t FROM x0),
brows AS (SELECT symbol AS model, n AS id, label + 1 AS y, CASE WHEN t IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS w, * FROM xs)""",
    boosted(_S4)) + f"""
SELECT symbol, tf, time, n, t, label, {_P3} FROM xs JOIN bprobs ON model = symbol AND id = n WHERE t IS NOT NULL"""

_WALK_FORWARD = _li(barrier_ctes("v11"), f"""
x0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS m, count(*) OVER (PARTITION BY symbol, tf) AS rows_ FROM feat WHERE {V11_OK}),
xf AS (SELECT *, rows_ // 6 AS size_, rows_ - (5 - fold) * (rows_ // 6) AS from_ FROM x0, (SELECT unnest(range(5)) AS fold)),
brows AS (SELECT symbol || '|' || fold AS model, n AS id, label + 1 AS y, CASE WHEN m < from_ THEN 1.0 ELSE 0.0 END::DOUBLE AS w, * FROM xf WHERE m < from_ + size_)""",
    boosted(V11_COLS), """
walked AS (SELECT b.symbol, b.tf, b.time, b.n, b.close, CAST(b.fold AS INTEGER) AS fold, b.label, b.slope_20, b.adx, p_sell, p_hold, p_buy FROM brows b JOIN bprobs p ON p.model = b.model AND p.id = b.id WHERE b.w = 0)""")
SQL["ml_walk_forward"] = _WALK_FORWARD + f"\nSELECT symbol, tf, time, n, fold, label, {_P3} FROM walked"
SQL["backtest_walk_forward"] = _WALK_FORWARD + f""",
test AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY n) - 1 AS t FROM walked),{B2B},{_equity('b4')}
SELECT {KEYCOLS}, t, fold, prediction, signal, {rnd('ret')} AS ret, {rnd('cost')} AS cost, {rnd('strat_ret')} AS strat_ret,
  {rnd('equity')} AS equity, {rnd('equity_bh')} AS equity_bh FROM eq"""

# --- streamed signals -----------------------------------------------------------------------

_CLOSED = SQL["stream_indicators"].split("\nSELECT symbol, tf, time, n,")[0]
SQL["stream_signals"] = with_ctes(events_bars("M15", 900, "allbars"), """
bars AS (SELECT * FROM allbars WHERE time + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""",
                                 NUMBERED, _signals_cte()) + SQL["strategy_signals"][SQL["strategy_signals"].rindex("\nSELECT symbol, tf, time, n, macd_state"):]
_T14 = trailing(14)
SQL["stream_technicals"] = _CLOSED + f"""
, t1 AS (SELECT *, (high + low + close) / 3.0 AS tp, {sma('close', 20)} AS mid, {masked_agg('stddev_pop(close)', 'close', 20)} AS sd FROM ta),
t2 AS (SELECT *, {lag('tp')} AS ptp FROM t1),
t3 AS (SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * tick_volume ELSE 0.0 END END AS pos,
              CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * tick_volume ELSE 0.0 END END AS neg FROM t2),
t4 AS (SELECT *, CASE WHEN count(pos) {_T14} = 14 THEN CASE WHEN sum(pos) {_T14} + sum(neg) {_T14} < 1.0 THEN 0.0
         ELSE 100.0 * sum(pos) {_T14} / (sum(pos) {_T14} + sum(neg) {_T14}) END END AS mfi FROM t3)
SELECT symbol, tf, time, n, {rnd(IND['atr'])} AS atr, {rnd(IND['adx'])} AS adx, {rnd('mfi')} AS mfi, {rnd('mid + 2.0 * sd')} AS bb_upper,
  {rnd('mid')} AS bb_middle, {rnd('mid - 2.0 * sd')} AS bb_lower, {rnd(IND['macd'])} AS macd, {rnd(IND['macd_signal'])} AS macd_signal,
  {rnd(IND['macd_hist'])} AS macd_hist FROM t4"""
