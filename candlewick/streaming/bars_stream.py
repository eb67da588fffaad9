"""Structured Streaming versions of the bar, state and decision operators.

* L1 ``tick_bars``: ticks → closed tumbling-window bars (watermark, append mode). Ticks
  later than the watermark are dropped (documented new behaviour).
* L3 ``keyed_trade_state`` and L4 ``keyed_peaks``: loss streak per symbol and peak floating
  profit per account and symbol in ``applyInPandasWithState`` (one or two numbers per key, keys in groups by hash).
* L5/L6 ``foreach_batch``: score / decide on each micro-batch against static tables,
  written idempotently per batch id.
Sinks and checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir

try:  # ship this module's state functions by value: workers need not import the package
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers then import the package
    pass


def _run_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, sf_dir: str, table: str, schema, max_files: int = 1) -> DataFrame:
    """A driver table, one file or a folder of files, as a file stream with bounded triggers."""
    # the pattern matches the table's own name; a folder's files are listed below it
    path = os.path.join(sf_dir, f"{table}.parque[t]")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as ticks (symbol, ts, price).

    Its files may overlap in time, so it is not streamed file by file: under a watermark, rows
    of later files would be late.
    """
    raw = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price")
    )


def tick_bars(ticks: DataFrame, tf_seconds: int, watermark: str, tf: str) -> DataFrame:
    """L1: closed OHLCV bars; a window is emitted once the watermark passes its end."""
    w = F.window("ts", f"{tf_seconds} seconds")
    return (
        ticks.withWatermark("ts", watermark)
        .groupBy("symbol", w.alias("w"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.count(F.lit(1)).alias("tick_volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("w.start").cast("timestamp_ntz").alias("time"),
                "open", "high", "low", "close", "tick_volume")
    )


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain ``stream`` with ``availableNow`` into parquet under the checkpoint folder.

    Append mode uses the parquet sink. Update mode writes each micro-batch to its own
    ``batch=<id>`` folder (overwritten on replay, so a retried batch is idempotent); the
    result then has a ``batch`` column and the newest batch per key is the current state.
    """
    out = _run_dir(spark, name)
    data = os.path.join(out, "data")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(out, "chk"))
    if mode == "append":
        writer = writer.format("parquet").option("path", data)
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(data, f"batch={batch_id}"))

        writer = writer.foreachBatch(write_batch)
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(data)


# --- keyed state --------------------------------------------------------------------------

#: Keyed state lies in this many groups of keys: a call of Python costs more than most keys' rows of a micro-batch.
KEY_GROUPS = 1024
KEPT = "kept string"
TRADE_ORDER = ("closed_at", "order_key", "line_number", "part_key")
OUT_SCHEMA = "symbol string, loss_streak long, n_seen long"


def _by_key_group(df: DataFrame, *keys: str) -> GroupedData:
    return df.withColumn("key_group", F.pmod(F.xxhash64(*keys), F.lit(KEY_GROUPS))).groupBy("key_group")


def _still_counting(trades: pd.DataFrame) -> pd.DataFrame:
    """Per symbol its newest non-loss, if any, and the losses after it."""
    symbol = pd.factorize(trades["symbol"], use_na_sentinel=False)[0]
    ends = (trades["profit"] >= 0).to_numpy(dtype=bool)
    order = np.lexsort((ends, *[trades[c].to_numpy() for c in reversed(TRADE_ORDER)], symbol))
    symbol, ends = symbol[order], ends[order]
    starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    at = np.arange(len(order))
    newest = np.maximum.reduceat(np.where(ends, at, -1), starts)
    return trades.iloc[order[at >= np.repeat(newest, np.diff(np.r_[starts, len(order)]))]]


def _trade_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold one micro-batch of some symbols' trades into their loss streaks.

    Only a symbol's newest non-loss and the losses after it matter, so the batch's frames are looked
    at one by one, in any order: memory is one frame and the losses that may still count.
    """
    kept = {s: (streak, seen) for s, streak, seen in json.loads(state.get[0])} if state.exists else {}
    counting, new = None, Counter()
    for pdf in batches:
        if len(pdf):
            new.update(pdf["symbol"].tolist())
            counting = _still_counting(pdf if counting is None else pd.concat([counting, pdf], ignore_index=True))
    if counting is None:
        return
    ended = counting["profit"] >= 0
    losses, ends = Counter(counting["symbol"][~ended].tolist()), set(counting["symbol"][ended].tolist())
    rows = [(s, losses[s] + (0 if s in ends else kept.get(s, (0, 0))[0]), kept.get(s, (0, 0))[1] + n) for s, n in new.items()]
    state.update((json.dumps([(s, *v) for s, v in (kept | {s: (streak, seen) for s, streak, seen in rows}).items()]),))
    yield pd.DataFrame(rows, columns=["symbol", "loss_streak", "n_seen"])


def keyed_trade_state(trades: DataFrame) -> DataFrame:
    """L3: loss streak (profit >= 0 resets) per symbol, as keyed state; a row per symbol and micro-batch.

    Micro-batches must follow one another in time; inside one, order does not matter.
    """
    return _by_key_group(trades, "symbol").applyInPandasWithState(_trade_state, OUT_SCHEMA, KEPT, "append", GroupStateTimeout.NoTimeout)


# --- F9, K5, L4: peak floating profit with reset ------------------------------------------------

PEAK_OUT = ("account_id long, symbol string, poll long, floating_profit double, peak double, close_all boolean, reason string")


class PollFold:
    """Polls in time order to (peak, reason). ``peak`` is carried: None before the first poll.

    A profit of ``percent`` of the balance or of ``dollars`` closes all before the peak is
    looked at; else the peak rises with the profit, and a fall of ``pullback`` percent from a
    positive peak closes all. Every close sets the peak to 0.
    """

    def __init__(self, percent: float, dollars: float, pullback: float, peak: float | None = None):
        self.percent, self.dollars, self.pullback, self.peak = percent, dollars, pullback, peak

    def __call__(self, profit: float, balance: float) -> tuple[float | None, str]:
        reason = ""
        if (self.percent > 0 and profit >= balance * (self.percent / 100.0)) or (self.dollars > 0 and profit >= self.dollars):
            reason = "profit"
        else:
            self.peak = profit if self.peak is None or profit > self.peak else self.peak
            if self.pullback > 0 and self.peak > 0 and (self.peak - profit) / self.peak * 100.0 >= self.pullback:
                reason = "pullback"
        seen = self.peak
        if reason:
            self.peak = 0.0
        return seen, reason


def _with_peaks(polls: pd.DataFrame, found: list[tuple[float | None, str]]) -> pd.DataFrame:
    out = polls[["account_id", "symbol", "poll", "floating_profit"]].copy()
    out["peak"] = pd.Series([p for p, _ in found], dtype=object, index=out.index)
    out["close_all"], out["reason"] = [r != "" for _, r in found], [r for _, r in found]
    return out


def peak_profit(polls: DataFrame, percent: float, dollars: float, pullback: float) -> DataFrame:
    """F9 + K5 over a poll history: keys lie sorted in their partition and stream through the fold,
    so a long history is never held in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            found = []
            for account, symbol, profit, balance in zip(pdf["account_id"], pdf["symbol"], pdf["floating_profit"], pdf["balance"]):
                if key != (account, symbol):
                    key, fold = (account, symbol), PollFold(percent, dollars, pullback)
                found.append(fold(profit, balance))
            yield _with_peaks(pdf, found)

    keys = ("account_id", "symbol")
    return polls.repartition(*keys).sortWithinPartitions(*keys, "ts", "poll").mapInPandas(run, PEAK_OUT)


def keyed_peaks(polls: DataFrame, percent: float, dollars: float, pullback: float) -> DataFrame:
    """L4: the same with the peak as keyed state; polls of a micro-batch are put in time order,
    micro-batches must follow one another in time."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        peaks = {(a, s): peak for a, s, peak in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(frames, ignore_index=True).sort_values(["ts", "poll"], kind="stable")
        accounts = rows["account_id"].astype(object).where(rows["account_id"].notna(), None).tolist()
        folds, found = {}, []
        for of, profit, balance in zip(zip(accounts, rows["symbol"].tolist()), rows["floating_profit"].tolist(), rows["balance"].tolist()):
            one = folds.get(of)
            if one is None:
                one = folds[of] = PollFold(percent, dollars, pullback, peaks.get(of))
            found.append(one(profit, balance))
        yield _with_peaks(rows, found)
        state.update((json.dumps([(*of, peak) for of, peak in (peaks | {of: one.peak for of, one in folds.items()}).items()]),))

    return _by_key_group(polls, "account_id", "symbol").applyInPandasWithState(
        fold, PEAK_OUT, KEPT, "append", GroupStateTimeout.NoTimeout)


def run_slices(spark: SparkSession, slices: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Let slices of a table arrive one after the other; each is drained before the next arrives."""
    out = _run_dir(spark, name)
    inbox, data = os.path.join(out, "inbox"), os.path.join(out, "data")
    for part in slices:
        part.write.mode("append").parquet(inbox)
        stream = build(spark.readStream.schema(part.schema).parquet(inbox))
        (stream.writeStream.outputMode("append").option("checkpointLocation", os.path.join(out, "chk")).format("parquet")
         .option("path", data).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(data)


def foreach_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str) -> None:
    """Run ``handle(batch_df, batch_id)`` per micro-batch (handler must be idempotent)."""
    spark = stream.sparkSession
    out = _run_dir(spark, name)
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination()


# --- L2: incremental indicators on closed bars -----------------------------------------------

IND_STATE = "n long, prev_close double, e12 double, e26 double, g double, l double"
IND_OUT = "symbol string, tf string, time timestamp_ntz, n long, close double, ema_12 double, ema_26 double, rsi_14 double"


def _ema_step(y: float, x: float, i: int, p: int) -> float:
    a = 2.0 / (p + 1)
    return y + x / p if i < p else (1.0 - a) * y + a * x


def _indicator_state(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """EMA(12), EMA(26) and Wilder RSI(14) carried across micro-batches per (symbol, tf).

    Same seeds as the batch operators (SMA warm-up); new bars of a micro-batch are applied
    in time order (bounded by the trigger size).
    """
    n, prev, e12, e26, g, l = state.get if state.exists else (0, None, 0.0, 0.0, 0.0, 0.0)
    frames = [pdf for pdf in batches if len(pdf)]
    rows = []
    if frames:
        pdf = pd.concat(frames, ignore_index=True).sort_values("time", kind="stable")
        for t, x in zip(pdf["time"], pdf["close"].to_numpy(dtype=float)):
            e12 = _ema_step(e12, x, n, 12)
            e26 = _ema_step(e26, x, n, 26)
            if prev is not None:
                d = x - prev
                j = n - 1
                gain, loss = max(d, 0.0), max(-d, 0.0)
                g = g + gain / 14.0 if j < 14 else (13.0 / 14.0) * g + gain / 14.0
                l = l + loss / 14.0 if j < 14 else (13.0 / 14.0) * l + loss / 14.0
            rsi = None
            if n >= 14:
                rsi = 0.0 if abs(g + l) < 1e-14 else 100.0 * g / (g + l)
            rows.append((key[0], key[1], t, n, x, e12 if n >= 11 else None, e26 if n >= 25 else None, rsi))
            prev = x
            n += 1
    state.update((int(n), prev, float(e12), float(e26), float(g), float(l)))
    cols = ["symbol", "tf", "time", "n", "close", "ema_12", "ema_26", "rsi_14"]
    yield pd.DataFrame(rows, columns=cols)


def keyed_indicators(bars: DataFrame) -> DataFrame:
    """L2: indicators updated bar by bar from a stream of closed bars."""
    return bars.groupBy("symbol", "tf").applyInPandasWithState(
        _indicator_state, IND_OUT, IND_STATE, "append", GroupStateTimeout.NoTimeout
    )
