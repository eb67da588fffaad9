"""I1 split and J1-J6 backtests as table jobs (no event loop).

The test frame is the chronological tail of each series (``int(0.8 * rows)`` onward).
Position-to-position state of the reference's loops reduces to ``lag``/``lead`` over the
test rows; equity curves are running products (``series.prefix_scan``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as L
from .series import KEYS, number_rows, prefix_scan, rolling

# Backtest costs and barriers of the reference simulations.
TRADING_COST = 0.0004
HORIZON = 5
TP_PCT = 0.015
SL_PCT = 0.008
MAX_HOLD = 10
TRAIN_FRACTION = 0.8


def chronological_split(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "n",
                        fraction: float = TRAIN_FRACTION) -> DataFrame:
    """``m`` = row position, ``t`` = position inside the test tail (null in train)."""
    df = number_rows(df, keys, order, out="m", total="_rows")
    split = F.floor(F.col("_rows") * F.lit(fraction)).cast("long")
    return df.withColumn("t", F.when(F.col("m") >= split, F.col("m") - split)).drop("_rows")


def bar_to_bar(test: DataFrame, signal: str = "signal", keys: Sequence[str] = KEYS,
               cost: float = TRADING_COST) -> DataFrame:
    """J1 + J4: position = signal; return ±r − cost on a change to a non-zero side.

    Rows of the last test bar have no next close and are dropped (the loop stops there).
    """
    def build(w):
        c = F.col("close")
        prev_pos = F.when(F.col("t") == 0, F.lit(0)).otherwise(F.lag(signal, 1).over(w))
        return [
            ("ret", F.try_divide(F.lead(c, 1).over(w) - c, c)),
            ("_prev_pos", prev_pos),
        ]

    df = rolling(test, build, back=1, fwd=1, keys=keys, idx="t")
    s = F.col(signal)
    fee = F.when((s != F.col("_prev_pos")) & (s != 0), F.lit(cost)).otherwise(F.lit(0.0))
    strat = F.when(s == 1, F.col("ret") - fee).when(s == -1, -F.col("ret") - fee).otherwise(F.lit(0.0))
    return df.filter(F.col("ret").isNotNull()).withColumn("cost", fee).withColumn("strat_ret", strat).drop("_prev_pos")


def horizon_returns(test: DataFrame, signal: str = "signal", keys: Sequence[str] = KEYS,
                    horizon: int = HORIZON) -> DataFrame:
    """Overlapping ``horizon``-bar returns signed by the prediction; last ``horizon`` dropped."""
    def build(w):
        c = F.col("close")
        return [("ret", F.try_divide(F.lead(c, horizon).over(w) - c, c))]

    df = rolling(test, build, back=0, fwd=horizon, keys=keys, idx="t")
    s = F.col(signal)
    strat = F.when(s == 1, F.col("ret")).when(s == -1, -F.col("ret")).otherwise(F.lit(0.0))
    return df.filter(F.col("ret").isNotNull()).withColumn("strat_ret", strat)


def tp_sl_returns(test: DataFrame, signal: str = "signal", keys: Sequence[str] = KEYS,
                  horizon: int = HORIZON, tp: float = TP_PCT, sl: float = SL_PCT,
                  max_hold: int = MAX_HOLD) -> DataFrame:
    """First touch of TP/SL on closes within ``max_hold`` bars (TP tested first);
    no touch → return to bar ``t+max_hold`` (clamped to the last bar). Hold leg and
    exit are clamped the same way; the last ``horizon`` rows are dropped."""
    def build(w):
        c = F.col("close")
        ahead = w.rowsBetween(1, max_hold)
        last_close = F.last(c).over(w.rowsBetween(0, max_hold))
        return [
            ("_closes", F.collect_list(c).over(ahead)),
            ("_exit", F.coalesce(F.lead(c, max_hold).over(w), last_close)),
            ("_hold_exit", F.coalesce(F.lead(c, horizon).over(w), F.last(c).over(w.rowsBetween(0, horizon)))),
            ("_keep", F.lead(c, horizon).over(w).isNotNull()),
        ]

    df = rolling(test, build, back=0, fwd=max(horizon, max_hold), keys=keys, idx="t")
    c = F.col("close")
    s = F.col(signal)
    long_tp, long_sl = c * F.lit(1 + tp), c * F.lit(1 - sl)
    short_tp, short_sl = c * F.lit(1 - tp), c * F.lit(1 + sl)
    long_hit = L.first_touch(F.col("_closes"), lambda x: x >= long_tp, lambda x: x <= long_sl)
    short_hit = L.first_touch(F.col("_closes"), lambda x: x <= short_tp, lambda x: x >= short_sl)
    hit = F.when(s == 1, long_hit).when(s == -1, short_hit).otherwise(F.lit(0))
    drift = F.when(s == 1, F.try_divide(F.col("_exit") - c, c)).otherwise(F.try_divide(c - F.col("_exit"), c))
    strat = (
        F.when(s == 0, F.lit(0.0))
        .when(hit == 1, F.lit(tp))
        .when(hit == -1, F.lit(-sl))
        .otherwise(drift)
    )
    return (
        df.filter(F.col("_keep"))
        .withColumn("ret", F.try_divide(F.col("_hold_exit") - c, c))
        .withColumn("strat_ret", strat)
        .drop("_closes", "_exit", "_hold_exit", "_keep")
    )


def equity_curves(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running products of (1 + strategy) and (1 + buy-and-hold) returns.

    ``t`` must be dense from 0 (the returns of the backtests above only lose a tail).
    """
    specs = [
        (F.lit(1.0) + F.col("strat_ret"), "product", "equity"),
        (F.lit(1.0) + F.col("ret"), "product", "equity_bh"),
    ]
    return prefix_scan(df, specs, keys=keys, idx="t")


def summary(returns: DataFrame, test: DataFrame, signal: str = "signal", keys: Sequence[str] = KEYS) -> DataFrame:
    """J6 + F5: total returns, test size and signal counts per series (partial aggregates)."""
    perf = returns.groupBy(*keys).agg(
        (F.product(F.lit(1.0) + F.col("strat_ret")) - F.lit(1.0)).alias("strategy_return"),
        (F.product(F.lit(1.0) + F.col("ret")) - F.lit(1.0)).alias("buy_hold_return"),
        F.count(F.lit(1)).alias("n_returns"),
    )
    s = F.col(signal)
    counts = test.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_size"),
        F.count_if(s == 1).alias("n_buy"),
        F.count_if(s == 0).alias("n_hold"),
        F.count_if(s == -1).alias("n_sell"),
    )
    return counts.join(perf, list(keys), "left")
