"""Technical indicators on every bar of every series.

Two kinds of building blocks:

* window columns (``sma``, ``bbands``, ``linreg_slope``, ``mfi`` …) take the ordered
  window ``w`` of a ``series.rolling`` pass and return columns;
* recurrence specs (``ema_rec``, ``wilder_rec`` …) describe ``y = q*y + u`` terms for
  ``recurrence.run``; seeds follow the public TA-Lib conventions (SMA seed over the
  first ``p`` valid values, written as a non-decaying warm-up).

``recurrence.run`` reads its rows twice, for the block ends and for the bars. The functions
that chain passes write the rows between them as tables, so that a chain costs as many
passes as it has and not twice as many with each.

Warm-up rows are null, never NaN. ``with_*`` functions are one-indicator conveniences;
feature sets pack many indicators into few passes (``features.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import recurrence
from .recurrence import Recurrence
from .series import KEYS, masked, number_bars, rolling, trailing

# TA-Lib treats |v| < 1e-14 as zero in RSI and ADX.
ZERO_EPS = 1e-14


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- window columns ---------------------------------------------------------------------


def sma(x, p: int, w: Window) -> Column:
    """Simple moving average of the last ``p`` values (all present)."""
    x = _c(x)
    return masked(F.avg(x).over(trailing(w, p)), x, w, p)


def long_sma(out: str, x, p: int, w: Window, step: int = 10) -> list[tuple[str, Column]]:
    """C1 for long periods, as pairs for ``rolling``: sums of ``step`` rows, ``p / step`` of them a row.

    A sliding frame adds up all its ``p`` rows again at every row; this takes ``step + p / step`` terms.
    """
    if p % step:
        raise ValueError("step must divide p")
    x, part = _c(x), f"_{out}_part"
    total = F.col(part)
    for k in range(step, p, step):
        # null if any part is
        total = total + F.lag(part, k).over(w)
    return [(part, masked(F.sum(x).over(trailing(w, step)), x, w, step)), (out, total / F.lit(float(p)))]


def rolling_std(x, p: int, w: Window, sample: bool = True) -> Column:
    """Rolling standard deviation (sample by default, as pandas)."""
    x = _c(x)
    f = F.stddev_samp if sample else F.stddev_pop
    return masked(f(x).over(trailing(w, p)), x, w, p)


def bbands(x, w: Window, p: int = 20, up: float = 2.0, dn: float = 2.0) -> tuple[Column, Column, Column]:
    """C4: Bollinger bands (SMA middle, population deviation)."""
    x = _c(x)
    mid = sma(x, p, w)
    sd = masked(F.stddev_pop(x).over(trailing(w, p)), x, w, p)
    return mid + F.lit(up) * sd, mid, mid - F.lit(dn) * sd


def linreg_slope(x, p: int, w: Window, idx: str = "n") -> Column:
    """C11: least-squares slope of the last ``p`` values against bar number."""
    x = _c(x)
    return masked(F.regr_slope(x, F.col(idx).cast("double")).over(trailing(w, p)), x, w, p)


def lag(x, k: int, w: Window) -> Column:
    """C14."""
    return F.lag(_c(x), k).over(w)


def lead(x, k: int, w: Window) -> Column:
    """C16."""
    return F.lead(_c(x), k).over(w)


def pct_change(x, k: int, w: Window) -> Column:
    """``x / x[t-k] - 1`` (null on a zero base)."""
    x = _c(x)
    return F.try_divide(x, F.lag(x, k).over(w)) - F.lit(1.0)


def true_range(high, low, prev_close) -> Column:
    """TR from bar 1: max(h-l, |h-pc|, |l-pc|); null without a previous close."""
    h, l, pc = _c(high), _c(low), _c(prev_close)
    return F.when(pc.isNotNull(), F.greatest(h - l, F.abs(h - pc), F.abs(l - pc)))


def directional_moves(high, low, prev_high, prev_low) -> tuple[Column, Column]:
    """+DM and -DM of one bar (TA-Lib rule: the larger move wins, ties give zero)."""
    up = _c(high) - _c(prev_high)
    down = _c(prev_low) - _c(low)
    valid = _c(prev_high).isNotNull()
    plus = F.when(valid, F.when((up > 0) & (up > down), up).otherwise(F.lit(0.0)))
    minus = F.when(valid, F.when((down > 0) & (up < down), down).otherwise(F.lit(0.0)))
    return plus, minus


def mfi(high, low, close, volume, w: Window, p: int = 14) -> Column:
    """Money-flow index; equal typical prices count in neither flow; <1 total → 0."""
    tp = (_c(high) + _c(low) + _c(close)) / F.lit(3.0)
    prev = F.lag(tp, 1).over(w)
    flow = tp * _c(volume).cast("double")
    pos = F.when(prev.isNotNull(), F.when(tp > prev, flow).otherwise(F.lit(0.0)))
    neg = F.when(prev.isNotNull(), F.when(tp < prev, flow).otherwise(F.lit(0.0)))
    frame = trailing(w, p)
    sp, sn = F.sum(pos).over(frame), F.sum(neg).over(frame)
    total = sp + sn
    value = F.when(total < F.lit(1.0), F.lit(0.0)).otherwise(F.lit(100.0) * sp / total)
    return F.when(F.count(pos).over(frame) == F.lit(p), value)


def crossed_above(a: Column, b: Column, w: Window) -> Column:
    """C17: previous a <= previous b and a > b."""
    return (F.lag(a, 1).over(w) <= F.lag(b, 1).over(w)) & (a > b)


def crossed_below(a: Column, b: Column, w: Window) -> Column:
    return (F.lag(a, 1).over(w) >= F.lag(b, 1).over(w)) & (a < b)


# --- recurrence specs --------------------------------------------------------------------


def _pos(idx: str, start: int) -> Column:
    return F.col(idx) - F.lit(start)


def smoothed_rec(name: str, x, p: int, alpha: float, start: int = 0, idx: str = "n") -> Recurrence:
    """EMA-type smoothing seeded by the SMA of the first ``p`` values from ``start``.

    Warm-up rows accumulate ``x/p`` without decay; later rows apply ``alpha``.
    The value is valid from ``start + p - 1`` (mask with ``valid_from``).
    """
    i = _pos(idx, start)
    x = _c(x)
    u = F.when(i < 0, F.lit(0.0)).when(i < p, x / F.lit(float(p))).otherwise(F.lit(alpha) * x)
    return Recurrence(name, 1.0 - alpha, u, decay=(i < 0) | (i >= p))


def ema_rec(name: str, x, p: int, start: int = 0, idx: str = "n") -> Recurrence:
    """EMA with alpha = 2/(p+1)."""
    return smoothed_rec(name, x, p, 2.0 / (p + 1), start, idx)


def ema_history(col: str, p: int, history: int, w) -> Column:
    """C2 over the newest ``history`` bars only: seeded by their first ``p`` bars, null before ``history`` bars.

    A fixed number of bars makes it a weighted sum of the frame, oldest first.
    """
    keep = 1.0 - 2.0 / (p + 1)
    weights = [keep ** (history - p) / p] * p + [(1.0 - keep) * keep ** (history - 1 - i) for i in range(p, history)]
    frame = w.rowsBetween(-(history - 1), 0)
    terms = F.zip_with(F.collect_list(col).over(frame), F.array(*[F.lit(x) for x in weights]), lambda x, a: x * a)
    value = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.when(F.count(col).over(frame) == F.lit(history), value)


def wilder_rec(name: str, x, p: int, start: int = 0, idx: str = "n") -> Recurrence:
    """Wilder smoothing (RSI, ATR): alpha = 1/p, SMA seed."""
    return smoothed_rec(name, x, p, 1.0 / p, start, idx)


def wilder_sum_rec(name: str, x, p: int, start: int = 0, idx: str = "n") -> Recurrence:
    """ADX's running sums: sum of the first ``p-1`` values, then ``S*(p-1)/p + x``."""
    i = _pos(idx, start)
    u = F.when(i < 0, F.lit(0.0)).otherwise(_c(x))
    return Recurrence(name, (p - 1.0) / p, u, decay=(i < 0) | (i >= p - 1))


def valid_from(y: Column, first: int, idx: str = "n") -> Column:
    return F.when(F.col(idx) >= F.lit(first), y)


# --- one-indicator conveniences (each is a complete plan) -------------------------------


def numbered(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df if "n" in df.columns else number_bars(df, keys)


def with_window_columns(df: DataFrame, build, back: int, fwd: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    return rolling(numbered(df, keys), build, back=back, fwd=fwd, keys=keys)


def with_sma(df: DataFrame, p: int, col: str = "close", out: str | None = None) -> DataFrame:
    out = out or f"sma_{p}"
    return with_window_columns(df, lambda w: [(out, sma(col, p, w))], back=p - 1)


def with_bbands(df: DataFrame, p: int = 20, k: float = 2.0, col: str = "close") -> DataFrame:
    def build(w):
        up, mid, lo = bbands(col, w, p, k, k)
        return [("bb_upper", up), ("bb_middle", mid), ("bb_lower", lo)]

    return with_window_columns(df, build, back=p - 1)


def with_ema(df: DataFrame, p: int, col: str = "close", out: str | None = None, keys=KEYS) -> DataFrame:
    out = out or f"ema_{p}"
    df = numbered(df, keys)
    df = recurrence.run(df, [ema_rec(out, col, p)], keys=keys)
    return df.withColumn(out, valid_from(F.col(out), p - 1))


def with_ma(df: DataFrame, p: int, matype: int = 0, col: str = "close", out: str | None = None) -> DataFrame:
    """MA by type code (0 SMA, 1 EMA)."""
    out = out or f"ma_{p}"
    if matype == 0:
        return with_sma(df, p, col, out)
    if matype == 1:
        return with_ema(df, p, col, out)
    raise ValueError(f"unsupported MA type {matype}")


def macd_recs(col, fast: int, slow: int, prefix: str = "macd") -> list[Recurrence]:
    """Fast and slow EMAs aligned as TA-Lib's MACD (fast seeded at bar slow-1)."""
    return [
        ema_rec(f"_{prefix}_fast", col, fast, start=slow - fast),
        ema_rec(f"_{prefix}_slow", col, slow, start=0),
    ]


def macd_finish(df: DataFrame, fast: int, slow: int, signal: int, prefix: str = "macd", keys=KEYS) -> DataFrame:
    """Signal pass and masks; expects the columns of ``macd_recs``."""
    line = F.col(f"_{prefix}_fast") - F.col(f"_{prefix}_slow")
    df = cut_lineage(df.withColumn(f"_{prefix}_line", valid_from(line, slow - 1)), "macd_line")
    df = recurrence.run(df, [ema_rec(f"_{prefix}_sig", f"_{prefix}_line", signal, start=slow - 1)], keys=keys)
    first = slow + signal - 2
    line = valid_from(F.col(f"_{prefix}_line"), first)
    sig = valid_from(F.col(f"_{prefix}_sig"), first)
    return df.withColumns({prefix: line, f"{prefix}_signal": sig, f"{prefix}_hist": line - sig}).drop(
        f"_{prefix}_fast", f"_{prefix}_slow", f"_{prefix}_line", f"_{prefix}_sig"
    )


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, col: str = "close",
              prefix: str = "macd", keys=KEYS) -> DataFrame:
    """MACD line, signal and histogram; first value at bar slow+signal-2."""
    df = numbered(df, keys)
    df = recurrence.run(df, macd_recs(col, fast, slow, prefix), keys=keys)
    return macd_finish(df, fast, slow, signal, prefix, keys)


def _with_prev(df: DataFrame, keys=KEYS) -> DataFrame:
    """Previous close, high and low, as a table: a recurrence reads its rows twice."""
    def build(w):
        return [
            ("_pc", lag("close", 1, w)),
            ("_ph", lag("high", 1, w)),
            ("_pl", lag("low", 1, w)),
        ]

    return cut_lineage(with_window_columns(df, build, back=1, keys=keys), "with_prev")


def rsi_inputs(close: str = "close", prev: str = "_pc") -> tuple[Column, Column]:
    d = F.col(close) - F.col(prev)
    gain = F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))
    loss = F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))
    return gain, loss


def rsi_value(g: Column, l: Column) -> Column:
    total = g + l
    return F.when(F.abs(total) < F.lit(ZERO_EPS), F.lit(0.0)).otherwise(F.lit(100.0) * g / total)


def with_rsi(df: DataFrame, p: int = 14, out: str | None = None, keys=KEYS) -> DataFrame:
    """Wilder RSI, first value at bar ``p``."""
    out = out or f"rsi_{p}"
    df = _with_prev(df, keys)
    gain, loss = rsi_inputs()
    df = recurrence.run(df, [wilder_rec("_g", gain, p, start=1), wilder_rec("_l", loss, p, start=1)], keys=keys)
    return df.withColumn(out, valid_from(rsi_value(F.col("_g"), F.col("_l")), p)).drop("_g", "_l", "_pc", "_ph", "_pl")


def with_atr(df: DataFrame, p: int = 14, out: str = "atr", natr: str | None = None, keys=KEYS) -> DataFrame:
    """C7 (and C8 when ``natr`` is named): Wilder ATR, first value at bar ``p``."""
    df = _with_prev(df, keys)
    tr = true_range("high", "low", "_pc")
    df = recurrence.run(df, [wilder_rec(out, tr, p, start=1)], keys=keys)
    df = df.withColumn(out, valid_from(F.col(out), p))
    if natr:
        df = df.withColumn(natr, natr_value(F.col(out), F.col("close")))
    return df.drop("_pc", "_ph", "_pl")


def natr_value(atr: Column, close: Column) -> Column:
    """100 * ATR / close (0 on a zero close)."""
    return F.when(close == 0, F.lit(0.0)).otherwise(F.lit(100.0) * atr / close)


def adx_recs(p: int = 14) -> list[Recurrence]:
    """Smoothed +DM, -DM and TR sums (valid from bar ``p-1``)."""
    plus, minus = directional_moves("high", "low", "_ph", "_pl")
    tr = true_range("high", "low", "_pc")
    return [
        wilder_sum_rec("_pdm", plus, p, start=1),
        wilder_sum_rec("_mdm", minus, p, start=1),
        wilder_sum_rec("_str", tr, p, start=1),
    ]


def dx_columns(p: int = 14) -> tuple[Column, Column]:
    """(dx, defined) from the smoothed sums; defined only from bar ``p``."""
    s_tr = F.col("_str")
    pdi = F.lit(100.0) * F.col("_pdm") / s_tr
    mdi = F.lit(100.0) * F.col("_mdm") / s_tr
    tr_ok = F.abs(s_tr) >= F.lit(ZERO_EPS)
    di_sum = F.when(tr_ok, pdi + mdi)
    defined = (F.col("n") >= F.lit(p)) & tr_ok & (F.abs(di_sum) >= F.lit(ZERO_EPS))
    dx = F.when(defined, F.lit(100.0) * F.abs(pdi - mdi) / di_sum)
    return dx, F.coalesce(defined, F.lit(False))


def adx_rec(name: str, p: int = 14) -> Recurrence:
    """ADX: mean DX over bars p…2p-1 (undefined DX counts 0), then Wilder on defined DX."""
    dx, defined = F.col("_dx"), F.col("_dx_ok")
    first = 2 * p - 1
    n = F.col("n")
    u = F.when(n < p, F.lit(0.0)).when(
        n <= first, F.coalesce(dx, F.lit(0.0)) / F.lit(float(p))
    ).otherwise(F.when(defined, dx / F.lit(float(p))).otherwise(F.lit(0.0)))
    decay = (n < p) | ((n > first) & defined)
    return Recurrence(name, (p - 1.0) / p, u, decay=decay)


def with_adx(df: DataFrame, p: int = 14, out: str = "adx", keys=KEYS) -> DataFrame:
    """ADX, first value at bar ``2p-1``."""
    df = _with_prev(df, keys)
    df = recurrence.run(df, adx_recs(p), keys=keys)
    dx, ok = dx_columns(p)
    df = df.withColumns({"_dx": dx, "_dx_ok": ok}).drop("_pdm", "_mdm", "_str", "_pc", "_ph", "_pl")
    df = cut_lineage(df, "dx")
    df = recurrence.run(df, [adx_rec(out, p)], keys=keys)
    return df.withColumn(out, valid_from(F.col(out), 2 * p - 1)).drop("_dx", "_dx_ok")


def with_mfi(df: DataFrame, p: int = 14, out: str = "mfi", keys=KEYS) -> DataFrame:
    return with_window_columns(df, lambda w: [(out, mfi("high", "low", "close", "tick_volume", w, p))], back=p, keys=keys)


def with_linreg_slope(df: DataFrame, p: int = 20, col: str = "close", out: str | None = None) -> DataFrame:
    out = out or f"linreg_slope_{p}"
    return with_window_columns(df, lambda w: [(out, linreg_slope(col, p, w))], back=p - 1)
