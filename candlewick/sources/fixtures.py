"""Account-side tables derived from the driver tables (schemas in FIXTURES.md).

Everything here is a plain projection/join/aggregate of a driver table, so it grows with
the data: positions from ``orders``, accounts from ``customer``, closed trades from
``lineitem``, model-probability stand-ins from bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.report import round_col
from .bars import orders_bars
from .tables import read_table

# Symbol properties used for every derived symbol.
SYMBOL_POINT = 0.01
SYMBOL_DIGITS = 2
SYMBOL_VOLUME_MIN = 0.01
SYMBOL_VOLUME_MAX = 50.0


def symbol_info(bars: DataFrame) -> DataFrame:
    """A5: one row per symbol seen in ``bars``."""
    return bars.select("symbol").distinct().select(
        "symbol",
        F.lit(SYMBOL_POINT).alias("point"),
        F.lit(SYMBOL_DIGITS).alias("digits"),
        F.lit(SYMBOL_VOLUME_MIN).alias("volume_min"),
        F.lit(SYMBOL_VOLUME_MAX).alias("volume_max"),
        F.lit(True).alias("visible"),
    )


def last_close(bars: DataFrame) -> DataFrame:
    """Latest close per symbol (partial aggregate)."""
    return bars.groupBy("symbol").agg(F.max_by("close", "time").alias("last_close"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 source: open positions from ``orders`` marked at the symbol's last close."""
    o = read_table(spark, sf_dir, "orders")
    marks = last_close(orders_bars(spark, sf_dir))
    k = F.col("o_orderkey")
    side = F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    base = o.select(
        F.col("o_custkey").alias("account_id"),
        k.alias("ticket"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(k % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("type"),
        (F.lit(0.01) * (F.lit(1) + k % 5)).alias("volume"),
        F.col("o_totalprice").alias("price_open"),
        side.alias("_side"),
        (k % 3).alias("magic"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("opened_at"),
    )
    p = base.join(marks, "symbol", "left").withColumn("price_current", F.col("last_close"))
    price_open = F.col("price_open")
    sl = F.when(F.col("ticket") % 4 == 0, round_col(price_open * (F.lit(1.0) - F.col("_side") * F.lit(0.02)), 2))
    tp = F.when(F.col("ticket") % 6 == 0, round_col(price_open * (F.lit(1.0) + F.col("_side") * F.lit(0.03)), 2))
    return p.select(
        "account_id", "ticket", "symbol", "type", "volume", "price_open", "price_current",
        F.coalesce(sl, F.lit(0.0)).alias("sl"),
        F.coalesce(tp, F.lit(0.0)).alias("tp"),
        round_col((F.col("price_current") - price_open) * F.col("_side") * F.col("volume"), 2).alias("profit"),
        "magic", "opened_at",
    )


def accounts(spark: SparkSession, sf_dir: str, open_positions: DataFrame | None = None) -> DataFrame:
    """Account snapshot; equity = balance + floating profit of its positions."""
    c = read_table(spark, sf_dir, "customer")
    pos = open_positions if open_positions is not None else positions(spark, sf_dir)
    floating = pos.groupBy("account_id").agg(F.sum("profit").alias("profit"))
    acc = c.select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("balance"))
    return acc.join(floating, "account_id", "left").select(
        "account_id",
        "balance",
        (F.col("balance") + F.coalesce(F.col("profit"), F.lit(0.0))).alias("equity"),
        F.coalesce(F.col("profit"), F.lit(0.0)).alias("profit"),
        (F.col("balance") + F.coalesce(F.col("profit"), F.lit(0.0))).alias("margin_free"),
    )


def equity_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account polls from ``orders``: balance and floating profit of (account, symbol) at each order."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("balance"))
    polls = o.select(
        F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("poll"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        round_col(F.col("o_totalprice") / F.lit(1000.0) - F.lit(150.0), 2).alias("floating_profit"),
    )
    return polls.join(c, "account_id")


def closed_trades(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Closed-trade history from ``lineitem``; zero profits reset loss streaks.

    ``symbol`` names the line's column that stands for the instrument, or ``o_orderpriority``
    for that of its order.
    """
    li = read_table(spark, sf_dir, "lineitem")
    if symbol == "o_orderpriority":
        orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), symbol)
        li = li.join(orders, "l_orderkey")
    return li.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("closed_at"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        round_col((F.col("l_discount") - F.lit(0.05)) * F.col("l_extendedprice"), 2).alias("profit"),
    )


def with_predictions(bars_numbered: DataFrame) -> DataFrame:
    """Deterministic stand-in for model probabilities (classes -1, 0, 1) from bar number."""
    n = F.col("n")
    a = (n % 7 + 1).cast("double")
    b = (n % 5 + 1).cast("double")
    c = (n % 3 + 1).cast("double")
    total = a + b + c
    return bars_numbered.withColumns({"p_sell": a / total, "p_hold": b / total, "p_buy": c / total})


def symbol_predictions(symbols: DataFrame) -> DataFrame:
    """Stand-in for the newest model output per symbol: by its first character sell, hold or buy leads."""
    turn = F.ascii("symbol") % 3

    def lead(k: int) -> Column:
        return F.when(turn == k, 0.6).otherwise(0.2)

    return symbols.withColumns({"p_sell": lead(2), "p_hold": lead(0), "p_buy": lead(1)})


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 source: a log line per ``events`` row (ts, symbol, level, msg, date)."""
    from ..functions.scalar import log_level

    e = read_table(spark, sf_dir, "events")
    msg = F.when(F.col("event_type") == "error", F.concat(F.lit("❌ "), F.col("event_type"))).when(
        F.col("event_type") == "purchase", F.concat(F.lit("✅ "), F.col("event_type"))
    ).otherwise(F.col("event_type"))
    return e.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_type").alias("symbol"),
        log_level(msg).alias("level"),
        msg.alias("msg"),
        F.to_date(F.col("ts")).alias("date"),
    )
