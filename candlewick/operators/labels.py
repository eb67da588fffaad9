"""Forward-looking three-class labels as leading window frames.

Each returns ``(name, column)`` pairs for a ``series.rolling`` pass with a forward halo;
``label_valid`` is false on the last bars of a series that the reference drops.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def barrier_label_cols(close: str, atr: str, w, params) -> list[tuple[str, Column]]:
    """G1: dynamic barrier over the next ``W`` closes.

    ``thr = max(floor, m * ATR / close)``; a missing ATR leaves ``thr`` missing and the
    label 0 (comparisons with NaN are false in the reference).
    """
    W = params.window
    c = F.col(close)
    ahead = w.rowsBetween(1, W)
    up = F.try_divide(F.max(c).over(ahead) - c, c)
    down = F.try_divide(c - F.min(c).over(ahead), c)
    thr = F.when(F.col(atr).isNotNull(), F.greatest(F.lit(params.floor), F.try_divide(F.lit(params.atr_mult) * F.col(atr), c)))
    buy = F.coalesce((up > thr) & (down < up * F.lit(0.5)), F.lit(False))
    sell = F.coalesce((down > thr) & (up < down * F.lit(0.5)), F.lit(False))
    label = F.when(buy, F.lit(1)).when(sell, F.lit(-1)).otherwise(F.lit(0))
    return [("label", label), ("label_valid", F.lead(c, W).over(w).isNotNull())]


def horizon_label_cols(close: str, w, horizon: int = 5, threshold: float = 0.002) -> list[tuple[str, Column]]:
    """``r = (close[t+h] - close) / close``; beyond ±threshold → ±1, else (and tail) 0."""
    c = F.col(close)
    r = F.try_divide(F.lead(c, horizon).over(w) - c, c)
    label = F.when(r > F.lit(threshold), F.lit(1)).when(r < F.lit(-threshold), F.lit(-1)).otherwise(F.lit(0))
    return [("label", label), ("label_valid", F.lit(True))]


def first_touch(items: Column, tp_hit, sl_hit) -> Column:
    """First element whose TP (tested first) or SL is hit: +1 / -1, 0 when none."""
    marks = F.transform(items, lambda s: F.when(tp_hit(s), F.lit(1)).when(sl_hit(s), F.lit(-1)).otherwise(F.lit(0)))
    return F.coalesce(F.element_at(F.filter(marks, lambda m: m != 0), 1), F.lit(0))


def triple_barrier_label_cols(w, horizon: int = 10, tp: float = 0.01, sl: float = 0.008) -> list[tuple[str, Column]]:
    """First touch of +tp (on high) / -sl (on low) within ``horizon`` bars; TP first."""
    c = F.col("close")
    items = F.collect_list(F.struct(F.col("high").alias("h"), F.col("low").alias("l"))).over(w.rowsBetween(1, horizon))
    up = c * F.lit(1.0 + tp)
    dn = c * F.lit(1.0 - sl)
    label = first_touch(items, lambda s: s["h"] >= up, lambda s: s["l"] <= dn)
    full = F.lead(c, horizon).over(w).isNotNull()
    return [("label", F.when(full, label).otherwise(F.lit(0))), ("label_valid", F.lit(True))]
