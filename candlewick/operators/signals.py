"""Indicator rules and model outputs turned into signals on every bar.

The reference evaluates each rule on the newest bar of a freshly fetched window; here
every bar gets the value the rule would give if that bar were the newest one (full
history; the reference's answer is the last row). Minimum-history rules (fewer than
100 / 50 / 200 bars) are expressed through the bar number ``n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax_class, decimal_text
from . import indicators as I
from . import recurrence
from .series import KEYS, SeriesFrame, number_bars

# Rule thresholds of the reference strategies.
RSI_BUY_LEVEL = 60.0
RSI_SELL_LEVEL = 40.0
SIDEWAYS_EMA_GAP_PCT = 0.1
SIDEWAYS_MACD_ABS = 0.0005
MIN_BARS_MACD = 100
MIN_BARS_EMA = 100
MIN_BARS_RSI = 100
MIN_BARS_SIDEWAYS = 100
MIN_BARS_BB = 50
MIN_BARS_TREND = 200

BULL, BEAR, NEUTRAL = "BULLISH", "BEARISH", "NEUTRAL"


def _enough(bars: int) -> Column:
    return F.col("n") >= F.lit(bars - 1)


def strategy_frame(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every indicator the rule strategies read, packed into four passes."""
    df = bars if "n" in bars.columns else number_bars(bars, keys)
    sf = SeriesFrame(df, back=19 + 1 + 2 * SeriesFrame.LR_BLOCK, keys=keys)
    sf.windows(lambda w: [("_pc", I.lag("close", 1, w)), ("bb_middle", I.sma("close", 20, w))])
    gain, loss = I.rsi_inputs()
    recs = [I.ema_rec(f"ema_{p}", "close", p) for p in (2, 9, 12, 21, 26, 200)]
    recs += [I.wilder_rec("_g", gain, 14, start=1), I.wilder_rec("_l", loss, 14, start=1)]
    recs += I.macd_recs("close", 12, 26, "macd") + I.macd_recs("close", 11, 27, "macd4")
    sf.recur(recs)
    cols = {f"ema_{p}": I.valid_from(F.col(f"ema_{p}"), p - 1) for p in (2, 9, 12, 21, 26, 200)}
    cols["rsi_14"] = I.valid_from(I.rsi_value(F.col("_g"), F.col("_l")), 14)
    cols["_macd_line"] = I.valid_from(F.col("_macd_fast") - F.col("_macd_slow"), 25)
    cols["_macd4_line"] = I.valid_from(F.col("_macd4_fast") - F.col("_macd4_slow"), 26)
    sf.columns(cols)
    sf.recur([I.ema_rec("_macd_sig", "_macd_line", 9, start=25), I.ema_rec("_macd4_sig", "_macd4_line", 4, start=26)])
    m, sg = I.valid_from(F.col("_macd_line"), 33), I.valid_from(F.col("_macd_sig"), 33)
    m4, s4 = I.valid_from(F.col("_macd4_line"), 29), I.valid_from(F.col("_macd4_sig"), 29)
    sf.columns({"macd": m, "macd_signal": sg, "macd_hist": m - sg, "macd4": m4, "macd4_signal": s4, "macd4_hist": m4 - s4})

    def prev(w):
        return [(f"_prev_{c}", F.lag(c, 1).over(w)) for c in
                ("macd", "macd_signal", "ema_12", "ema_26", "ema_2", "bb_middle", "macd4_hist")]

    drop = ["_pc", "_g", "_l", "_macd_fast", "_macd_slow", "_macd4_fast", "_macd4_slow", "_macd_line",
            "_macd4_line", "_macd_sig", "_macd4_sig"]
    return sf.windows(prev).result().drop(*drop)


def macd_state(fast="macd", slow="macd_signal", prev_fast="_prev_macd", prev_slow="_prev_macd_signal") -> Column:
    """H1: BUY/SELL on a crossing, BULLISH/BEARISH by side, else NEUTRAL; null before 100 bars."""
    m, s, pm, ps = F.col(fast), F.col(slow), F.col(prev_fast), F.col(prev_slow)
    state = (
        F.when((pm <= ps) & (m > s), F.lit("BUY"))
        .when((pm >= ps) & (m < s), F.lit("SELL"))
        .when(m > s, F.lit(BULL))
        .when(m < s, F.lit(BEAR))
        .otherwise(F.lit(NEUTRAL))
    )
    return F.when(_enough(MIN_BARS_MACD), state)


def ema_side(fast="ema_12", slow="ema_26") -> Column:
    """H2: side of the fast EMA (its crossing branch gives the same answer)."""
    f, s = F.col(fast), F.col(slow)
    side = F.when(f > s, F.lit(BULL)).when(f < s, F.lit(BEAR)).otherwise(F.lit(NEUTRAL))
    return F.when(_enough(MIN_BARS_EMA), side).otherwise(F.lit(NEUTRAL))


def rsi_side(rsi="rsi_14", buy=RSI_BUY_LEVEL, sell=RSI_SELL_LEVEL) -> Column:
    """H3."""
    r = F.col(rsi)
    side = F.when(r > buy, F.lit(BULL)).when(r < sell, F.lit(BEAR)).otherwise(F.lit(NEUTRAL))
    return F.when(_enough(MIN_BARS_RSI), side).otherwise(F.lit(NEUTRAL))


def bb_ma_macd(ma="ema_2", mid="bb_middle", macd="macd4", hist="macd4_hist") -> tuple[Column, Column]:
    """H4: EMA(2) crossing the BB middle, confirmed by MACD(11,27,4) against its histogram."""
    m, pm, b, pb = F.col(ma), F.col(f"_prev_{ma}"), F.col(mid), F.col(f"_prev_{mid}")
    mc, h, ph = F.col(macd), F.col(hist), F.col(f"_prev_{hist}")
    buy = F.coalesce((pm <= pb) & (m > b) & ((mc < h) | (mc < ph)), F.lit(False))
    sell = F.coalesce((pm >= pb) & (m < b) & ((mc > h) | (mc > ph)), F.lit(False))
    sig = F.when(buy, F.lit(BULL)).when(sell, F.lit(BEAR)).otherwise(F.lit(NEUTRAL))
    # The reason texts
    reason = (
        F.when(buy, F.lit("MA>BB_mid, MACD<Hist"))
        .when(sell, F.lit("MA<BB_mid, MACD>Hist"))
        .otherwise(F.concat(F.lit("MA:"), decimal_text(m, 5), F.lit(" BB:"), decimal_text(b, 5)))
    )
    ok = _enough(MIN_BARS_BB)
    return F.when(ok, sig).otherwise(F.lit(NEUTRAL)), F.when(ok, reason).otherwise(F.lit(""))


def trend_ema200(tf: Column | None = None) -> tuple[Column, Column]:
    """H5: price against EMA200 with a reason text (both columns always)."""
    c, e = F.col("close"), F.col("ema_200")
    tfc = F.col("tf") if tf is None else tf
    name = F.when(tfc.isin("H4", "D1"), tfc).otherwise(F.lit("H1"))
    sig = F.when(c > e, F.lit(BULL)).when(c < e, F.lit(BEAR)).otherwise(F.lit(NEUTRAL))
    rel = F.when(c > e, F.lit(">")).when(c < e, F.lit("<")).otherwise(F.lit("≈"))
    reason = F.format_string("(%s price %s EMA200)", name, rel)
    ok = _enough(MIN_BARS_TREND)
    return F.when(ok, sig).otherwise(F.lit(NEUTRAL)), F.when(ok, reason).otherwise(F.lit(""))


def sideways(fast="ema_9", slow="ema_21", macd="macd") -> Column:
    """H6: EMAs within 0.1 % and |MACD| < 0.0005; false before 100 bars."""
    gap = F.try_divide(F.abs(F.col(fast) - F.col(slow)), F.col(slow)) * F.lit(100.0)
    flat = (gap < F.lit(SIDEWAYS_EMA_GAP_PCT)) & (F.abs(F.col(macd)) < F.lit(SIDEWAYS_MACD_ABS))
    return F.coalesce(_enough(MIN_BARS_SIDEWAYS) & flat, F.lit(False))


def macd_zero_side(macd="macd") -> Column:
    """H7: +1 above zero, -1 below, 0 otherwise (or missing)."""
    m = F.col(macd)
    return F.when(m > 0, F.lit(1)).when(m < 0, F.lit(-1)).otherwise(F.lit(0))


def combined(ema="ema_signal", rsi="rsi_signal", zero="macd_zero") -> Column:
    """H8: EMA side, MACD side of zero and RSI level all agree."""
    bull = (F.col(ema) == BULL) & (F.col(zero) == 1) & (F.col(rsi) == BULL)
    bear = (F.col(ema) == BEAR) & (F.col(zero) == -1) & (F.col(rsi) == BEAR)
    return F.when(bull, F.lit(BULL)).when(bear, F.lit(BEAR)).otherwise(F.lit(NEUTRAL))


def trend_gated(sig="combined", trend="trend") -> Column:
    """The combined signal only in the direction of the trend."""
    s, t = F.col(sig), F.col(trend)
    return F.when((t == BULL) & (s == BULL), F.lit(BULL)).when((t == BEAR) & (s == BEAR), F.lit(BEAR)).otherwise(F.lit(NEUTRAL))


def strategy_signals(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """H1-H8, H13 on every bar."""
    return rule_columns(strategy_frame(bars, keys))


def rule_columns(df: DataFrame) -> DataFrame:
    """The rules' columns beside the indicators of ``strategy_frame``, batch or streamed."""
    bb_sig, bb_reason = bb_ma_macd()
    tr_sig, tr_reason = trend_ema200()
    df = df.select(
        "*",
        macd_state().alias("macd_state"),
        ema_side().alias("ema_signal"),
        rsi_side().alias("rsi_signal"),
        bb_sig.alias("bb_signal"),
        bb_reason.alias("bb_reason"),
        tr_sig.alias("trend"),
        tr_reason.alias("trend_reason"),
        sideways().alias("sideways"),
        macd_zero_side().alias("macd_zero"),
    )
    return df.withColumn("combined", combined()).withColumn("trend_combined", trend_gated())


def trend_signals(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """H5 alone: only the EMA200 is computed."""
    df = bars if "n" in bars.columns else number_bars(bars, keys)
    df = recurrence.run(df, [I.ema_rec("ema_200", "close", 200)], keys=keys)
    trend, reason = trend_ema200()
    return df.withColumns({"trend": trend, "trend_reason": reason}).drop("ema_200")


def choose_strategy(use_ai: bool, use_bb: bool, use_trend: bool,
                    ai="ai_signal", bb="bb_signal", comb="combined", gated="trend_combined",
                    side="sideways") -> Column:
    """Model, else BB/MA/MACD, else (unless sideways) combined, trend-gated if on."""
    if use_ai:
        return F.col(ai)
    if use_bb:
        return F.col(bb)
    rule = F.col(gated) if use_trend else F.col(comb)
    return F.when(F.col(side), F.lit(NEUTRAL)).otherwise(rule)


def choose_by_symbol(strategy: Column, use_trend: bool = True, ai="ai_signal", bb="bb_signal") -> Column:
    """H14 with the strategy as a column of a per-symbol configuration: ``ai``, ``bb`` or the rules."""
    rules = choose_strategy(False, False, use_trend)
    return F.when(strategy == "ai", F.col(ai)).when(strategy == "bb", F.col(bb)).otherwise(rules)


# --- model-driven signals ------------------------------------------------------------------


def prob_array(p_sell="p_sell", p_hold="p_hold", p_buy="p_buy") -> Column:
    return F.array(F.col(p_sell), F.col(p_hold), F.col(p_buy))


def model_class(probs: Column) -> Column:
    """Class (-1, 0, 1) of the first maximum."""
    return argmax_class(probs)


def confidence_gate(probs: Column, threshold: float) -> Column:
    """Class when its probability reaches ``threshold``, else 0."""
    return F.when(F.array_max(probs) >= F.lit(threshold), model_class(probs)).otherwise(F.lit(0))


def slope_limit(adx="adx") -> Column:
    """H11 limit: 0.00012 when ADX > 25, else 0.00006."""
    return F.when(F.col(adx) > 25, F.lit(0.00012)).otherwise(F.lit(0.00006))


# Fixed value: the slope limit of the V10.1 backtest.
V10_SLOPE_LIMIT = 0.0001


def slope_gate_backtest(sig: Column, slope="slope_20", limit: Column | None = None) -> Column:
    """H11 (backtest form): zero a signal that goes against a slope beyond ±limit."""
    lim = slope_limit() if limit is None else limit
    s = F.col(slope)
    against = ((sig == 1) & (s < -lim)) | ((sig == -1) & (s > lim))
    return F.when(F.coalesce(against, F.lit(False)), F.lit(0)).otherwise(sig)


def slope_gate_live(sig: Column, slope="slope_20", limit: Column | None = None) -> Column:
    """H11 (live form): keep BUY only when slope > -limit, SELL only when slope < limit."""
    lim = slope_limit() if limit is None else limit
    s = F.col(slope)
    keep = ((sig == 1) & (s > -lim)) | ((sig == -1) & (s < lim))
    return F.when(F.coalesce(keep, F.lit(False)), sig).otherwise(F.lit(0))


def volatility_veto(sig: Column, vol="volatility", vol_mean="volatility_mean20") -> Column:
    """NEUTRAL (0) when volatility exceeds twice its 20-bar mean."""
    hot = F.coalesce(F.col(vol) > F.lit(2.0) * F.col(vol_mean), F.lit(False))
    return F.when(hot, F.lit(0)).otherwise(sig)
