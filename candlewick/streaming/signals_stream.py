"""L2: indicators and rule signals bar by bar on a stream of closed bars, as keyed state.

State of a (symbol, timeframe): one number per recurrence (EMAs, MACD lines, Wilder sums), a ring
of the last 20 closes and of the last 14 money flows, and the previous bar's values that the
rules look back at. It does not grow with the history. The rules themselves (H1-H8, H13)
are the column expressions of the batch operator, applied to the streamed indicators.

Micro-batches must follow one another in time (``bar_slices`` with ``run_slices``); a key's bars
of one micro-batch are put in time order, and a slice holds at most ``SLICE_BARS`` of them.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import signals as SG

try:  # ship this module's state functions by value: workers need not import the package
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers then import the package
    pass

#: Bars of a key that arrive together at most.
SLICE_BARS = 4096
EMAS = (2, 9, 12, 21, 26, 200)
LOOKED_BACK_AT = ("macd", "macd_signal", "ema_12", "ema_26", "ema_2", "bb_middle", "macd4_hist")
INDICATORS = (*(f"ema_{p}" for p in EMAS), "rsi_14", "atr", "adx", "mfi", "bb_upper", "bb_middle", "bb_lower",
              "macd", "macd_signal", "macd_hist", "macd4", "macd4_signal", "macd4_hist")
OUT = ("symbol string, tf string, time timestamp_ntz, n long, close double, "
       + ", ".join(f"{c} double" for c in (*INDICATORS, *(f"_prev_{c}" for c in LOOKED_BACK_AT))))
EPS = 1e-14


class BarFold:
    """Closed bars in time order to the indicators of each; ``state`` is all that is carried."""

    def __init__(self, state: str | None = None):
        kept = json.loads(state) if state else {}
        self.n = kept.get("n", 0)
        self.y = kept.get("y", {})
        self.bar = kept.get("bar")  # high, low, close and typical price of the previous bar
        self.closes, self.flows = kept.get("closes", []), kept.get("flows", [])
        self.before = kept.get("before", {})

    @property
    def state(self) -> str:
        return json.dumps({"n": self.n, "y": self.y, "bar": self.bar, "closes": self.closes, "flows": self.flows, "before": self.before})

    def smoothed(self, name: str, x: float | None, p: int, keep: float, start: int = 0) -> float:
        """Seeded by the mean of the first ``p`` values from bar ``start`` on, then ``keep * y + (1 - keep) * x``."""
        i, y = self.n - start, self.y.get(name, 0.0)
        if i >= 0 and x is not None:
            y = y + x / p if i < p else keep * y + (1.0 - keep) * x
        self.y[name] = y
        return y

    def wilder_sum(self, name: str, x: float | None, p: int) -> float:
        i, y = self.n - 1, self.y.get(name, 0.0)
        if i >= 0 and x is not None:
            y = y + x if i < p - 1 else y * ((p - 1.0) / p) + x
        self.y[name] = y
        return y

    def macd(self, name: str, close: float, fast: int, slow: int, signal: int) -> dict[str, float | None]:
        f = self.smoothed(f"{name}_fast", close, fast, 1.0 - 2.0 / (fast + 1), slow - fast)
        s = self.smoothed(f"{name}_slow", close, slow, 1.0 - 2.0 / (slow + 1))
        line = f - s
        sig = self.smoothed(f"{name}_sig", line, signal, 1.0 - 2.0 / (signal + 1), slow - 1)
        if self.n < slow + signal - 2:
            return {name: None, f"{name}_signal": None, f"{name}_hist": None}
        return {name: line, f"{name}_signal": sig, f"{name}_hist": line - sig}

    def adx(self, high: float, low: float, true_range: float | None, p: int = 14) -> float | None:
        up, down = (high - self.bar[0], self.bar[1] - low) if self.bar else (0.0, 0.0)
        started = true_range is not None
        plus = self.wilder_sum("pdm", (up if up > 0 and up > down else 0.0) if started else None, p)
        minus = self.wilder_sum("mdm", (down if down > 0 and up < down else 0.0) if started else None, p)
        ranges = self.wilder_sum("str", true_range, p)
        dx = None
        if self.n >= p and abs(ranges) >= EPS:
            a, b = 100.0 * plus / ranges, 100.0 * minus / ranges
            if abs(a + b) >= EPS:
                dx = 100.0 * abs(a - b) / (a + b)
        first, y = 2 * p - 1, self.y.get("adx", 0.0)
        if p <= self.n <= first:
            y += (dx or 0.0) / p
        elif self.n > first and dx is not None:
            y = y * ((p - 1.0) / p) + dx / p
        self.y["adx"] = y
        return y if self.n >= first else None

    def mfi(self, typical: float, volume: float, p: int = 14) -> float | None:
        if self.bar:
            flow = typical * volume
            self.flows = [*self.flows, [flow if typical > self.bar[3] else 0.0, flow if typical < self.bar[3] else 0.0]][-p:]
        if len(self.flows) < p:
            return None
        pos, neg = (sum(f[i] for f in self.flows) for i in (0, 1))
        return 0.0 if pos + neg < 1.0 else 100.0 * pos / (pos + neg)

    def bands(self, close: float, p: int = 20) -> dict[str, float | None]:
        self.closes = [*self.closes, close][-p:]
        if len(self.closes) < p:
            return {"bb_upper": None, "bb_middle": None, "bb_lower": None}
        mid = sum(self.closes) / p
        sd = math.sqrt(sum((c - mid) ** 2 for c in self.closes) / p)
        return {"bb_upper": mid + 2.0 * sd, "bb_middle": mid, "bb_lower": mid - 2.0 * sd}

    def __call__(self, high: float, low: float, close: float, volume: float) -> dict[str, float | int | None]:
        n, out = self.n, {}
        for p in EMAS:
            y = self.smoothed(f"e{p}", close, p, 1.0 - 2.0 / (p + 1))
            out[f"ema_{p}"] = y if n >= p - 1 else None
        change = close - self.bar[2] if self.bar else None
        true_range = max(high - low, abs(high - self.bar[2]), abs(low - self.bar[2])) if self.bar else None
        g = self.smoothed("g", None if change is None else max(change, 0.0), 14, 13.0 / 14.0, 1)
        d = self.smoothed("l", None if change is None else max(-change, 0.0), 14, 13.0 / 14.0, 1)
        out["rsi_14"] = None if n < 14 else 0.0 if abs(g + d) < EPS else 100.0 * g / (g + d)
        atr = self.smoothed("atr", true_range, 14, 13.0 / 14.0, 1)
        out["atr"] = atr if n >= 14 else None
        out["adx"] = self.adx(high, low, true_range)
        typical = (high + low + close) / 3.0
        out["mfi"] = self.mfi(typical, volume)
        out |= self.bands(close) | self.macd("macd", close, 12, 26, 9) | self.macd("macd4", close, 11, 27, 4)
        now = {c: out[c] for c in LOOKED_BACK_AT}
        out |= {f"_prev_{c}": self.before.get(c) for c in LOOKED_BACK_AT}
        self.before, self.bar, self.n = now, [high, low, close, typical], n + 1
        return {"n": n, "close": close} | out


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fold = BarFold(state.get[0] if state.exists else None)
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    bars = pd.concat(frames, ignore_index=True).sort_values("time", kind="stable")  # a slice, not a history
    cols = (bars[c].astype(float).tolist() for c in ("high", "low", "close", "tick_volume"))
    rows = pd.DataFrame([fold(*bar) for bar in zip(*cols)])
    rows.insert(0, "time", bars["time"].to_numpy())
    rows.insert(0, "tf", key[1])
    rows.insert(0, "symbol", key[0])
    state.update((fold.state,))
    for c in rows.columns[5:]:
        rows[c] = rows[c].astype(float).astype(object).where(rows[c].notna(), None)
    yield rows


def keyed_technicals(bars: DataFrame) -> DataFrame:
    """C2-C10 on a stream: every indicator of ``INDICATORS`` per closed bar, and the previous bar's that the rules need."""
    rows = bars.select("symbol", "tf", "time", "high", "low", "close", "tick_volume")
    return rows.groupBy("symbol", "tf").applyInPandasWithState(_fold, OUT, "kept string", "append", GroupStateTimeout.NoTimeout)


def keyed_signals(bars: DataFrame) -> DataFrame:
    """H1-H8 and H13 on a stream of closed bars: the batch rules over the streamed indicators."""
    return SG.rule_columns(keyed_technicals(bars))


def bar_slices(bars: DataFrame, bar_seconds: int, most: int = SLICE_BARS) -> list[DataFrame]:
    """Slices of a bar table that follow one another in time, each of at most ``most`` bars of a key."""
    at = F.unix_seconds(F.col("time").cast("timestamp"))
    low, high = bars.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [bars]
    step = bar_seconds * most
    return [bars.where((at >= a) & (at < a + step)) for a in range(low, high + 1, step)]
