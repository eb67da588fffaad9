"""Named feature sets, each packed into few passes over the series.

Pass layout of every set (shuffles are on ``(symbol, tf, block)``, never the symbol alone):

1. ``number_bars``;
2. window pass on raw bars (lags, SMA/BB/slope/MFI, candle shapes);
3. recurrence level 1 (EMAs, MACD legs, Wilder RSI/ATR, ADX sums), lineage cut;
4. recurrence level 2 (ADX, MACD signal);
5. window pass over indicator outputs plus the forward label window.

The feature rows are then those without nulls (B6), as the reference's ``dropna``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import indicators as I
from . import labels as L
from . import recurrence
from .series import KEYS, SeriesFrame, number_bars, rolling

# Ordered model columns of each reference feature set.
V11_COLUMNS = [
    "slope_20", "adx", "sqz_idx", "atr_ratio", "rsi_14", "mfi", "macd_hist",
    "price_in_bb", "dist_sma_200", "dist_sma_20", "natr", "body_size", "upper_wick", "hour", "market_active",
]
V10_COLUMNS = [
    "slope_30", "adx", "sqz_idx", "rsi_14", "mfi", "macd_hist",
    "price_in_bb", "dist_sma_200", "natr", "body_size", "hour", "market_active",
]
MOMENTUM25_COLUMNS = [
    "ema_cross", "price_to_ema12", "price_to_ema26", "ema12_slope", "ema26_slope",
    "macd_line", "macd_signal", "macd_hist", "macd_cross", "macd_hist_slope",
    "rsi_14", "rsi_slope", "rsi_buy_signal", "rsi_sell_signal", "rsi_trend_strength",
    "price_change", "price_momentum", "volatility", "volatility_ratio",
    "body_ratio", "body_momentum", "upper_shadow_ratio", "lower_shadow_ratio",
    "doji", "engulfing",
]
SIMPLE4_COLUMNS = ["sma_10", "sma_30", "rsi_14", "price_change"]
SESSION30_COLUMNS = [
    "h1_slope", "h1_slope_accel", "london_session", "ny_session", "ny_volatility",
    *MOMENTUM25_COLUMNS,
]
# Higher-timeframe columns built beside the 30 model columns (not in the model's list).
HTF_COLUMNS = [
    "price_to_ema200_h1", "htf_slope", "m15_slope", "h1_macd", "h1_rsi", "h1_rsi_slope", "h1_adx",
    "h1_adx_slope", "h1_trend", "m15_trend", "trend_alignment",
]
# Defaults of the joined higher-timeframe columns when no bar matches.
HTF_DEFAULTS = {"h1_rsi": 50.0, "h1_adx": 25.0}

FEATURE_SETS = {
    "v11": V11_COLUMNS,
    "v10": V10_COLUMNS,
    "momentum25": MOMENTUM25_COLUMNS,
    "simple4": SIMPLE4_COLUMNS,
    "session30": SESSION30_COLUMNS,
}

EPS10 = 1e-10


@dataclass(frozen=True)
class BarrierParams:
    """G1 parameters of the dynamic-barrier sets."""

    window: int
    atr_mult: float
    floor: float = 0.0035


# Fixed values: (forward window, ATR multiple) of V11.2 and V10.1.
V11_BARRIER = BarrierParams(12, 1.25)
V10_BARRIER = BarrierParams(14, 1.3)


def _prev_cols(w):
    return [("_pc", I.lag("close", 1, w)), ("_ph", I.lag("high", 1, w)), ("_pl", I.lag("low", 1, w))]


def dynamic_barrier_features(
    bars: DataFrame,
    version: str = "v11",
    *,
    with_label: bool = True,
    atr_scope: str = "trimmed",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Feature sets ``v11`` (V11.2) and ``v10`` (V10.1) with their G1 label.

    Returns all bars from the first complete feature row on, with ``label`` (and
    ``label_valid`` false on the last ``W`` bars, which the reference drops).
    """
    v11 = version == "v11"
    slope_p = 20 if v11 else 30
    barrier = V11_BARRIER if v11 else V10_BARRIER
    first_row = 199  # SMA200 is the longest warm-up of both sets
    df = bars if "n" in bars.columns else number_bars(bars, keys)

    def raw(w):
        up, mid, lo = I.bbands("close", w, 20, 2.0, 2.0)
        cols = _prev_cols(w) + [
            ("_slope", I.linreg_slope("close", slope_p, w)),
            ("_bb_up", up), ("_bb_mid", mid), ("_bb_lo", lo),
            ("_sma200", I.sma("close", 200, w)),
            ("mfi", I.mfi("high", "low", "close", "tick_volume", w, 14)),
        ]
        return cols

    fwd = barrier.window if with_label else 0
    sf = SeriesFrame(df, back=max(199, 49 + 2 * SeriesFrame.LR_BLOCK), fwd=fwd, keys=keys).windows(raw)
    gain, loss = I.rsi_inputs()
    tr = I.true_range("high", "low", "_pc")
    recs = [
        I.wilder_rec("_atr", tr, 14, start=1),
        I.wilder_rec("_g", gain, 14, start=1),
        I.wilder_rec("_l", loss, 14, start=1),
        *I.macd_recs("close", 12, 26),
        *I.adx_recs(14),
    ]
    if with_label and atr_scope == "trimmed":
        # ATR restarted on the trimmed frame (first TR used is one bar after it starts)
        recs.append(I.wilder_rec("_atr_lbl", F.when(F.col("n") > first_row, tr), 14, start=first_row + 1))
    sf.recur(recs)
    dx, ok = I.dx_columns(14)
    sf.columns({
        "_dx": dx, "_dx_ok": ok,
        "_macd_line": I.valid_from(F.col("_macd_fast") - F.col("_macd_slow"), 25),
    })
    sf.recur([I.adx_rec("adx", 14), I.ema_rec("_macd_sig", "_macd_line", 9, start=25)])
    masks = {
        "adx": I.valid_from(F.col("adx"), 27),
        "_atr": I.valid_from(F.col("_atr"), 14),
        "rsi_14": I.valid_from(I.rsi_value(F.col("_g"), F.col("_l")), 14),
        "_macd_hist": I.valid_from(F.col("_macd_line") - F.col("_macd_sig"), 33),
    }
    if with_label:
        masks["_atr_l"] = (
            I.valid_from(F.col("_atr_lbl"), first_row + 14) if atr_scope == "trimmed"
            else I.valid_from(F.col("_atr"), 14)
        )
    sf.columns(masks)

    def derived(w):
        cols = [("_atr_sma50", I.sma("_atr", 50, w))]
        if with_label:
            cols += L.barrier_label_cols("close", "_atr_l", w, barrier)
        return cols

    df = sf.windows(derived).result()
    c = F.col("close")
    band = F.col("_bb_up") - F.col("_bb_lo")
    rng = F.col("high") - F.col("low")
    out = {
        "adx": F.col("adx"),
        "sqz_idx": S.guarded_ratio(band, "_atr"),
        "rsi_14": F.col("rsi_14"),
        "mfi": F.col("mfi"),
        "macd_hist": S.guarded_ratio("_macd_hist", c),
        "price_in_bb": S.guarded_ratio(c - F.col("_bb_lo"), band),
        "dist_sma_200": S.guarded_ratio(c - F.col("_sma200"), "_sma200"),
        "natr": I.natr_value(F.col("_atr"), c),
        "hour": F.hour(F.col("time")),
        "market_active": S.market_active(F.hour(F.col("time"))),
    }
    if v11:
        out["slope_20"] = S.guarded_ratio("_slope", c)
        out["atr_ratio"] = S.ratio("_atr", "_atr_sma50")
        out["dist_sma_20"] = S.guarded_ratio(c - F.col("_bb_mid"), "_bb_mid")
        out["body_size"] = S.guarded_ratio(c - F.col("open"), rng)
        out["upper_wick"] = S.guarded_ratio(F.col("high") - F.greatest(c, F.col("open")), rng)
        names = V11_COLUMNS
    else:
        out["slope_30"] = S.ratio("_slope", c)
        out["body_size"] = S.guarded_ratio(F.abs(c - F.col("open")), rng)
        names = V10_COLUMNS
    select = [*keys, "time", "n", "open", "high", "low", "close", "tick_volume"]
    select += [out[name].alias(name) for name in names]
    if with_label:
        select += [F.col("label"), F.col("label_valid")]
    out_df = df.filter(F.col("n") >= first_row).select(*select).na.drop(subset=names)
    return out_df


def momentum25_features(
    bars: DataFrame,
    *,
    with_label: bool = True,
    horizon: int = 5,
    threshold: float = 0.002,
    keys: Sequence[str] = KEYS,
    label: str = "horizon",
    session: bool = False,
) -> DataFrame:
    """The 25-column EMA/MACD/RSI/candle set with the fixed-horizon label.

    ``session`` adds the own-timeframe columns of the 30-column set (D17, D21 and the M15
    slope of D19); ``label="triple"`` uses the triple-barrier label (G3) instead.
    """
    df = bars if "n" in bars.columns else number_bars(bars, keys)
    c = F.col("close")
    o = F.col("open")
    h = F.col("high")
    lo = F.col("low")

    def raw(w):
        body = F.abs(c - o)
        rng = h - lo + F.lit(EPS10)
        vol = F.try_divide(I.rolling_std("close", 10, w), c)
        direction = F.when(c > o, F.lit(1)).otherwise(F.lit(-1))
        return [
            ("_pc", I.lag("close", 1, w)),
            ("price_change", I.pct_change("close", 1, w)),
            ("price_momentum", I.pct_change("close", 3, w)),
            ("volatility", vol),
            ("volatility_ratio", F.try_divide(F.col("volatility"), I.sma("volatility", 20, w))),
            ("body_ratio", body / rng),
            ("body_momentum", F.col("body_ratio") - I.sma("body_ratio", 5, w)),
            ("upper_shadow_ratio", (h - F.greatest(o, c)) / rng),
            ("lower_shadow_ratio", (F.least(o, c) - lo) / rng),
            ("doji", (F.col("body_ratio") < F.lit(0.1)).cast("int")),
            ("_dir", direction),
            ("engulfing", S.engulfing(F.col("_dir"), F.lag("_dir", 1).over(w), body, F.lag(body, 1).over(w))),
        ]

    fwd = (10 if label == "triple" else horizon) if with_label else 0
    sf = SeriesFrame(df, back=max(28, 4 + 2 * SeriesFrame.LR_BLOCK), fwd=fwd, keys=keys).windows(raw)
    gain, loss = I.rsi_inputs()
    sf.recur([
        I.ema_rec("_ema12", "close", 12),
        I.ema_rec("_ema26", "close", 26),
        I.wilder_rec("_g", gain, 14, start=1),
        I.wilder_rec("_l", loss, 14, start=1),
        *I.macd_recs("close", 12, 26),
    ])
    sf.columns({"_macd_line": I.valid_from(F.col("_macd_fast") - F.col("_macd_slow"), 25)})
    sf.recur([I.ema_rec("_macd_sig", "_macd_line", 9, start=25)])
    macd = I.valid_from(F.col("_macd_line"), 33)
    sig = I.valid_from(F.col("_macd_sig"), 33)
    sf.columns({
        "_ema12": I.valid_from(F.col("_ema12"), 11),
        "_ema26": I.valid_from(F.col("_ema26"), 25),
        "rsi_14": I.valid_from(I.rsi_value(F.col("_g"), F.col("_l")), 14),
        "_macd": macd,
        "_macd_signal": sig,
        "_macd_hist": macd - sig,
    })

    def derived(w):
        cols = [
            ("_d_e12", F.col("_ema12") - F.lag("_ema12", 1).over(w)),
            ("_d_e26", F.col("_ema26") - F.lag("_ema26", 1).over(w)),
            ("_d_hist", F.col("_macd_hist") - F.lag("_macd_hist", 1).over(w)),
            ("_d_rsi", F.col("rsi_14") - F.lag("rsi_14", 1).over(w)),
            ("ema12_slope", I.sma("_d_e12", 3, w)),
            ("ema26_slope", I.sma("_d_e26", 3, w)),
            ("macd_hist_slope", I.sma("_d_hist", 3, w)),
            ("rsi_slope", I.sma("_d_rsi", 3, w)),
        ]
        if session:
            e1, e2 = F.lag("_ema12", 1).over(w), F.lag("_ema12", 2).over(w)
            cols += [
                ("h1_slope_accel", F.col("ema26_slope") - F.lag("ema26_slope", 1).over(w)),
                ("m15_slope", F.coalesce(F.try_divide(e1 - e2, e1) * F.lit(100.0), F.lit(0.0))),
            ]
        if with_label and label == "triple":
            cols += L.triple_barrier_label_cols(w, 10, 0.01, 0.008)
        elif with_label:
            cols += L.horizon_label_cols("close", w, horizon, threshold)
        return cols

    df = sf.windows(derived).result()
    e12, e26 = F.col("_ema12"), F.col("_ema26")
    rsi = F.col("rsi_14")
    out = {
        "ema_cross": F.try_divide(e12 - e26, e26),
        "price_to_ema12": F.try_divide(c - e12, e12),
        "price_to_ema26": F.try_divide(c - e26, e26),
        "macd_line": F.try_divide(F.col("_macd"), c),
        "macd_signal": F.try_divide(F.col("_macd_signal"), c),
        "macd_hist": F.try_divide(F.col("_macd_hist"), c),
        "macd_cross": F.try_divide(F.col("_macd") - F.col("_macd_signal"), c),
        "rsi_buy_signal": (rsi - F.lit(60.0)) / F.lit(40.0),
        "rsi_sell_signal": (rsi - F.lit(40.0)) / F.lit(40.0),
        "rsi_trend_strength": F.abs(rsi - F.lit(50.0)) / F.lit(50.0),
    }
    select = [*keys, "time", "n", "open", "high", "low", "close", "tick_volume"]
    for name in MOMENTUM25_COLUMNS:
        select.append(out[name].alias(name) if name in out else F.col(name))
    names = list(MOMENTUM25_COLUMNS)
    if session:
        hour = F.hour(F.col("time"))
        ny = S.session_flag(hour, S.NEW_YORK_HOURS)
        select += [
            F.col("ema26_slope").alias("h1_slope"), F.col("h1_slope_accel"),
            S.session_flag(hour, S.LONDON_HOURS).alias("london_session"), ny.alias("ny_session"),
            (ny * F.col("volatility")).alias("ny_volatility"), F.col("m15_slope"), F.col("_ema12").alias("ema_12"),
        ]
        names += ["h1_slope_accel"]
    if with_label:
        select += [F.col("label"), F.col("label_valid")]
    out_df = df.select(*select).na.drop(subset=names)
    return out_df


def higher_timeframe_inputs(h1_bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """EMA200, MACD line, RSI, ADX on the higher timeframe, their slopes, all lagged
    one higher-timeframe bar (no look-ahead)."""
    df = h1_bars if "n" in h1_bars.columns else number_bars(h1_bars, keys)
    sf = SeriesFrame(df, back=2 + 2 * SeriesFrame.LR_BLOCK, keys=keys).windows(_prev_cols)
    gain, loss = I.rsi_inputs()
    sf.recur([I.ema_rec("_e200", "close", 200), *I.macd_recs("close", 12, 26),
              I.wilder_rec("_g", gain, 14, start=1), I.wilder_rec("_l", loss, 14, start=1), *I.adx_recs(14)])
    dx, ok = I.dx_columns(14)
    sf.columns({"_dx": dx, "_dx_ok": ok})
    sf.recur([I.adx_rec("_adx", 14)])
    sf.columns({
        "_ema200": I.valid_from(F.col("_e200"), 199),
        "_macd": I.valid_from(F.col("_macd_fast") - F.col("_macd_slow"), 33),
        "_rsi": I.valid_from(I.rsi_value(F.col("_g"), F.col("_l")), 14),
        "_adxv": I.valid_from(F.col("_adx"), 27),
    })

    def lagged(w):
        prev_e = F.lag("_ema200", 1).over(w)
        return [
            ("_slope", F.try_divide(F.col("_ema200") - prev_e, prev_e) * F.lit(100.0)),
            ("_rsi_slope", F.col("_rsi") - F.lag("_rsi", 1).over(w)),
            ("_adx_slope", F.col("_adxv") - F.lag("_adxv", 1).over(w)),
            ("h1_ema200", F.lag("_ema200", 1).over(w)),
            ("h1_macd", F.lag("_macd", 1).over(w)),
            ("h1_rsi", F.lag("_rsi", 1).over(w)),
            ("h1_adx", F.lag("_adxv", 1).over(w)),
            ("h1_slope", F.lag("_slope", 1).over(w)),
            ("h1_rsi_slope", F.lag("_rsi_slope", 1).over(w)),
            ("h1_adx_slope", F.lag("_adx_slope", 1).over(w)),
        ]

    df = sf.windows(lagged).result()
    return df.select("symbol", "time", "h1_ema200", "h1_macd", "h1_rsi", "h1_adx", "h1_slope",
                     "h1_rsi_slope", "h1_adx_slope")


def session30_features(m15_bars: DataFrame, h1_bars: DataFrame, *, with_label: bool = True,
                       tolerance_seconds: int = 900, keys: Sequence[str] = KEYS) -> DataFrame:
    """D17-D21 + the 30-column model set with the triple-barrier label.

    Higher-timeframe inputs join backward as-of within ``tolerance_seconds`` (E1); rows
    without a match take the defaults (B8). The model's ``h1_slope`` is the own-timeframe
    EMA26 slope (as in the reference); the joined slope is kept as ``htf_slope``.
    """
    from .joins import asof_backward

    base = momentum25_features(m15_bars, with_label=with_label, label="triple", session=True, keys=keys)
    htf = higher_timeframe_inputs(h1_bars, keys)
    j = asof_backward(base, htf, tolerance_seconds=tolerance_seconds)
    c = F.col("close")
    h1_slope = F.coalesce(F.col("r_h1_slope"), F.lit(0.0))
    m15_slope = F.col("m15_slope")
    h1_trend = F.when(h1_slope > 0, F.lit(1)).otherwise(F.lit(-1))
    m15_trend = F.when(m15_slope > 0, F.lit(1)).otherwise(F.lit(-1))
    out = j.withColumns({
        "price_to_ema200_h1": F.coalesce(F.try_divide(c - F.col("r_h1_ema200"), c) * F.lit(100.0), F.lit(0.0)),
        "htf_slope": h1_slope,
        "h1_macd": F.coalesce(F.try_divide(F.col("r_h1_macd"), c) * F.lit(1000.0), F.lit(0.0)),
        "h1_rsi": S.fill_default("r_h1_rsi", HTF_DEFAULTS["h1_rsi"]),
        "h1_rsi_slope": S.fill_default("r_h1_rsi_slope", 0.0),
        "h1_adx": S.fill_default("r_h1_adx", HTF_DEFAULTS["h1_adx"]),
        "h1_adx_slope": S.fill_default("r_h1_adx_slope", 0.0),
        "h1_trend": h1_trend,
        "m15_trend": m15_trend,
        "trend_alignment": F.when(h1_trend == m15_trend, F.lit(1.0)).otherwise(F.lit(-1.0)),
    })
    cols = [*keys, "time", "n", "open", "high", "low", "close", "tick_volume", *SESSION30_COLUMNS, *HTF_COLUMNS]
    if with_label:
        cols += ["label", "label_valid"]
    out = out.select(*cols)
    return out


def simple4_features(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """sma_10, sma_30, rsi_14, price_change (rows with all four present)."""
    df = bars if "n" in bars.columns else number_bars(bars, keys)

    def raw(w):
        return [
            ("_pc", I.lag("close", 1, w)),
            ("sma_10", I.sma("close", 10, w)),
            ("sma_30", I.sma("close", 30, w)),
            ("price_change", I.pct_change("close", 1, w)),
        ]

    df = rolling(df, raw, back=29, keys=keys)
    gain, loss = I.rsi_inputs()
    df = recurrence.run(df, [I.wilder_rec("_g", gain, 14, start=1), I.wilder_rec("_l", loss, 14, start=1)], keys=keys)
    df = df.withColumn("rsi_14", I.valid_from(I.rsi_value(F.col("_g"), F.col("_l")), 14))
    return df.select(*keys, "time", "n", "close", *SIMPLE4_COLUMNS).na.drop(subset=SIMPLE4_COLUMNS)


def build_features(bars: DataFrame, feature_set: str, **kw) -> DataFrame:
    """One entry point for the named sets."""
    if feature_set in ("v11", "v10"):
        return dynamic_barrier_features(bars, feature_set, **kw)
    if feature_set == "momentum25":
        return momentum25_features(bars, **kw)
    if feature_set == "simple4":
        return simple4_features(bars)
    if feature_set == "session30":
        raise ValueError("session30 needs both timeframes: use session30_features(m15, h1)")
    raise ValueError(f"unknown feature set {feature_set}")


def feature_columns(feature_set: str) -> list[str]:
    return list(FEATURE_SETS[feature_set])

