"""Bars: ticks rolled up to OHLCV, bar-to-bar roll-up, last-N and latest-tick reads.

A3 (bars at any timeframe) is a partial + final hash aggregate on ``(symbol, tf, time)``:
a hot instrument is spread over its time slots and combined map-side, so no single task
sees all of its ticks. Open and close are ``min_by`` / ``max_by`` on an explicit order key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import epoch_seconds, number_bars, prefix_scan, timeframe_seconds, timeframe_seconds_col
from .tables import read_table

BAR_COLUMNS = ("symbol", "tf", "time", "open", "high", "low", "close", "tick_volume")


def bar_start(ts: Column, tf: str) -> Column:
    """Start of the ``tf`` slot holding ``ts`` (epoch aligned), as timestamp_ntz."""
    size = timeframe_seconds(tf)
    secs = F.floor(epoch_seconds(ts) / F.lit(size)) * F.lit(size)
    return F.timestamp_seconds(secs).cast("timestamp_ntz")


def order_key(order: Sequence[str]) -> Column:
    """One sortable column for a tie-break order; a null key sorts first."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def ticks_to_bars(
    ticks: DataFrame,
    tf: str,
    *,
    symbol: str = "symbol",
    ts: str = "ts",
    price: str = "price",
    order: Sequence[str] | None = None,
    volume: str | None = None,
) -> DataFrame:
    """A3: OHLCV bars of ``tf`` from a tick table; ``order`` breaks ties inside a bar."""
    order_cols = list(order) if order else [ts]
    ordering = order_key(order_cols)
    vol = F.count(F.lit(1)) if volume is None else F.sum(volume)
    return (
        ticks.select(
            F.col(symbol).alias("symbol"),
            bar_start(F.col(ts), tf).alias("time"),
            F.col(price).cast("double").alias("_p"),
            ordering.alias("_o"),
            *([] if volume is None else [F.col(volume)]),
        )
        .groupBy("symbol", "time")
        .agg(
            F.min_by("_p", "_o").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"),
            vol.cast("long").alias("tick_volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), "time", "open", "high", "low", "close", "tick_volume")
    )


def bars_by_code(ticks: DataFrame, order: Sequence[str] = ("ts", "price")) -> DataFrame:
    """A2 + A3 with the timeframe code as a column ``code``: its own bars for every row's code."""
    size = timeframe_seconds_col(F.col("code"))
    start = F.timestamp_seconds(F.floor(epoch_seconds(F.col("ts")) / size) * size).cast("timestamp_ntz")
    rows = ticks.select("code", size.alias("bar_seconds"), "symbol", start.alias("time"), "price", order_key(order).alias("_o"))
    return rows.groupBy("code", "bar_seconds", "symbol", "time").agg(
        F.min_by("price", "_o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "_o").alias("close"), F.count(F.lit(1)).alias("tick_volume"))


def rollup_bars(bars: DataFrame, tf: str) -> DataFrame:
    """A3 bar-to-bar: coarser bars from finer ones (first open, last close by time)."""
    return (
        bars.select("symbol", bar_start(F.col("time"), tf).alias("_t"), "time", "open", "high", "low", "close", "tick_volume")
        .groupBy("symbol", "_t")
        .agg(
            F.min_by("open", "time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "time").alias("close"),
            F.sum("tick_volume").cast("long").alias("tick_volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("_t").alias("time"), "open", "high", "low", "close", "tick_volume")
    )


# --- bars derived from the driver tables (FIXTURES.md) -------------------------------


def lineitem_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Primary bar source: D1 bars per return flag (or another column), price = extended price per unit."""
    li = read_table(spark, sf_dir, "lineitem")
    ticks = li.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    ).filter(F.col("price").isNotNull())
    return ticks_to_bars(ticks, "D1", order=["l_orderkey", "l_linenumber", "l_partkey"])


def orders_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    ticks = o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        "o_orderkey",
    )
    return ticks_to_bars(ticks, "D1", order=["o_orderkey"])


def tape_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long M1 series: every order is a minute of one tape, its lines the minute's ticks."""
    li = read_table(spark, sf_dir, "lineitem")
    ticks = li.select(
        F.lit("TAPE").alias("symbol"),
        F.timestamp_seconds(F.lit(946_684_800) + F.col("l_orderkey") * 60).alias("ts"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        "l_linenumber",
        "l_partkey",
    ).filter(F.col("price").isNotNull())
    return ticks_to_bars(ticks, "M1", order=["l_linenumber", "l_partkey", "price"])


# Start and step of the price walks.
WALK_START, WALK_STEP = 1.1, 0.00001


def walk_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three M1 price walks: an order is a minute, its lines' discounts above or below 5 % are up or down steps."""
    li = read_table(spark, sf_dir, "lineitem")
    minutes = li.groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long") - 5).alias("step"), F.count(F.lit(1)).alias("tick_volume"))
    rows = minutes.select(
        F.concat(F.lit("W"), F.col("l_orderkey") % 3).alias("symbol"), F.lit("M1").alias("tf"),
        F.timestamp_seconds(F.lit(946_684_800) + F.col("l_orderkey") * 60).cast("timestamp_ntz").alias("time"), "step", "tick_volume")
    walked = prefix_scan(number_bars(rows), [("step", "sum", "level")])

    def price(steps: Column) -> Column:
        return F.lit(WALK_START) + steps.cast("double") * F.lit(WALK_STEP)

    before, after = F.col("level") - F.col("step"), F.col("level")
    return walked.select(
        "symbol", "tf", "time", price(before).alias("open"), price(F.greatest(before, after) + F.col("tick_volume")).alias("high"),
        price(F.least(before, after) - F.col("tick_volume")).alias("low"), price(after).alias("close"), "tick_volume")


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick table from ``events`` (symbol, ts, bid, ask, size)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts"),
        F.col("value").alias("bid"),
        (F.col("value") * F.lit(1.0002)).alias("ask"),
        F.get_json_object("props", "$.k").cast("int").alias("size"),
    )


def events_bars(spark: SparkSession, sf_dir: str, tf: str = "M15") -> DataFrame:
    ticks = events_ticks(spark, sf_dir).select("symbol", "ts", F.col("bid").alias("price"))
    return ticks_to_bars(ticks, tf, order=["ts", "price"])


# --- reads -----------------------------------------------------------------------------


def last_n_bars(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """A1: the newest ``n`` bars of every key, for any ``n``.

    Positions and series lengths come from chunk counts, so no series is sorted as a whole.
    """
    numbered = number_bars(bars, keys, out="_n", total="_total")
    return numbered.filter(F.col("_n") >= F.col("_total") - F.lit(n)).drop("_n", "_total")


def latest_tick(ticks: DataFrame) -> DataFrame:
    """A4: newest bid/ask per symbol (partial aggregate, any skew)."""
    return ticks.groupBy("symbol").agg(
        F.max("ts").alias("ts"), F.max_by("bid", "ts").alias("bid"), F.max_by("ask", "ts").alias("ask")
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the ``orders`` symbols (order priority), price = total price."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("bid"),
        (F.col("o_totalprice") * F.lit(1.0002)).alias("ask"),
    )


def latest_quote(ticks: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """A4 with an explicit tie-break order."""
    key = F.struct(*[F.col(c) for c in order])
    return ticks.groupBy("symbol").agg(F.max_by("bid", key).alias("bid"), F.max_by("ask", key).alias("ask"))
