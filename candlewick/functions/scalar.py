"""Scalar column functions (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session hours (UTC) of the reference.
MARKET_ACTIVE_HOURS = (14, 20)  # inclusive
LONDON_HOURS = (8, 16)  # [start, end)
NEW_YORK_HOURS = (13, 21)  # [start, end)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded_ratio(a, b, eps: float = 1e-9) -> Column:
    """B1: a / (b + eps)."""
    return _c(a) / (_c(b) + F.lit(eps))


def ratio(a, b) -> Column:
    """B2: unguarded ratio; a zero divisor gives null instead of an error."""
    return F.try_divide(_c(a), _c(b))



def market_active(hour) -> Column:
    """1 when the hour is in [14, 20]."""
    lo, hi = MARKET_ACTIVE_HOURS
    return _c(hour).between(lo, hi).cast("int")


def session_flag(hour, hours: tuple[int, int]) -> Column:
    """1.0 inside [start, end), else 0.0."""
    h = _c(hour)
    return ((h >= hours[0]) & (h < hours[1])).cast("double")


def fill_default(x, default: float) -> Column:
    """B8."""
    return F.coalesce(_c(x), F.lit(default))



def round_digits(x, digits) -> Column:
    """B10 with a per-row number of digits."""
    scale = F.pow(F.lit(10.0), _c(digits).cast("double"))
    return F.bround(_c(x) * scale, 0) / scale


def whole_points(diff, point) -> Column:
    """``int(diff / point)`` (truncation toward zero)."""
    return (_c(diff) / _c(point)).cast("bigint")


def clamp(x, lo, hi) -> Column:
    """B12."""
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def decimal_text(x, digits: int) -> Column:
    """``%.<digits>f`` of ``x`` rounded first by plain IEEE steps (``floor(x*10^d + 0.5)``),
    so the text does not depend on the formatter's own tie rule."""
    scale = float(10**digits)
    v = F.floor(_c(x).cast("double") * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.format_string(f"%.{digits}f", v)


def price_text(x) -> Column:
    """``%.5f`` or empty when zero / absent."""
    v = _c(x)
    return F.when(v.isNotNull() & (v != 0), decimal_text(v, 5)).otherwise(F.lit(""))


def money_text(x) -> Column:
    return decimal_text(x, 2)


def clock_text(ts) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def class_text(cls) -> Column:
    """1 → BULLISH, -1 → BEARISH, else NEUTRAL."""
    c = _c(cls)
    return F.when(c == 1, F.lit("BULLISH")).when(c == -1, F.lit("BEARISH")).otherwise(F.lit("NEUTRAL"))


def side_code(text) -> Column:
    """BUY/BULLISH → 1, SELL/BEARISH → -1, else 0."""
    t = F.upper(_c(text))
    return F.when(t.isin("BUY", "BULLISH"), F.lit(1)).when(t.isin("SELL", "BEARISH"), F.lit(-1)).otherwise(F.lit(0))


def engulfing(direction, prev_direction, body, prev_body) -> Column:
    """D16 via B16: +1 bullish / -1 bearish engulfing, else 0 (close == open counts down)."""
    big = _c(body) > _c(prev_body) * F.lit(1.5)
    d, pd = _c(direction), _c(prev_direction)
    bull = F.coalesce((d == 1) & (pd == -1) & big, F.lit(False))
    bear = F.coalesce((d == -1) & (pd == 1) & big, F.lit(False))
    return F.when(bull, F.lit(1)).when(bear, F.lit(-1)).otherwise(F.lit(0))


def log_level(msg) -> Column:
    """Severity from the message marks (✅ ok; ❌ or ⚠️ error; else info)."""
    m = _c(msg)
    return (
        F.when(m.contains("✅"), F.lit("success"))
        .when(m.contains("❌") | m.contains("⚠️"), F.lit("error"))
        .otherwise(F.lit("info"))
    )


def pl_sign(x) -> Column:
    """Three-way sign of a P/L figure."""
    return F.signum(_c(x)).cast("int")



def argmax_class(probs, classes=(-1, 0, 1)) -> Column:
    """Class of the first maximum of a probability array."""
    p = _c(probs)
    pos = F.array_position(p, F.array_max(p))
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pos.cast("int"))
