"""Position books and risk rules as columns over account tables.

Every rule evaluates all accounts, symbols and positions of a snapshot at once; the
per-symbol state of the reference (loss streak, peak profit) comes from aggregates of
the trade history. Dimension tables (symbol info, per-symbol aggregates) are joined with
plain equi-joins and left to AQE to broadcast when their measured size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, decimal_text, round_digits, side_code, whole_points


@dataclass(frozen=True)
class StrategyConfig:
    """A10: strategy settings; defaults are the reference's fixed values."""

    initial_lot: float = 0.01
    max_lot: float = 1.0
    martingale_mult: float = 1.5
    max_risk_percent: float = 10.0
    sl_points: float = 0.0
    tp_points: float = 0.0
    use_trailing: bool = False
    trailing_distance: float = 0.0
    close_all_percent: float = 0.1
    close_all_dollar: float = 0.0
    close_all_pullback: float = 0.0
    max_per_side: int = 1
    use_sl_tp: bool = True
    close_profit: float = 10.0
    close_loss: float = 20.0
    use_ai: bool = True
    use_bb_ma_macd: bool = False
    use_trend_filter: bool = True
    use_grid: bool = False
    grid_distance: float = 300.0
    max_grid_orders: int = 10


def parse_symbols(text: Column) -> Column:
    """A10: ``"A, B"`` → array of trimmed, non-empty symbols."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")


# --- aggregations -------------------------------------------------------------------------


def position_book(positions: DataFrame, keys=("account_id", "symbol")) -> DataFrame:
    """Side counts, grid anchors (lowest BUY / highest SELL open, 0 if none), total."""
    buy = F.col("type") == "BUY"
    sell = F.col("type") == "SELL"
    return positions.groupBy(*keys).agg(
        F.count_if(buy).alias("n_buy"),
        F.count_if(sell).alias("n_sell"),
        F.coalesce(F.min(F.when(buy, F.col("price_open"))), F.lit(0.0)).alias("buy_anchor"),
        F.coalesce(F.max(F.when(sell, F.col("price_open"))), F.lit(0.0)).alias("sell_anchor"),
        F.count(F.lit(1)).alias("grid_count"),
    )


TRADE_ORDER = ("closed_at", "order_key", "line_number", "part_key")


def loss_streaks(trades: DataFrame, order=TRADE_ORDER) -> DataFrame:
    """current consecutive-loss count per symbol (profit >= 0 resets) and F11 counts.

    Two partial aggregates and one join on the per-symbol table: the newest non-loss per
    symbol, then the losses after it. No per-symbol ordering of the whole history.
    """
    key = F.struct(*[F.col(c) for c in order])
    t = trades.withColumn("_k", key)
    last_ok = t.filter(F.col("profit") >= 0).groupBy("symbol").agg(F.max("_k").alias("_reset"))
    totals = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_closed"),
        F.count_if(F.col("profit") < 0).alias("n_losses"),
    )
    after = (
        t.filter(F.col("profit") < 0)
        .join(last_ok, "symbol", "left")
        .filter(F.col("_reset").isNull() | (F.col("_k") > F.col("_reset")))
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("loss_streak"))
    )
    return totals.join(after, "symbol", "left").select(
        "symbol", "n_closed", "n_losses", F.coalesce(F.col("loss_streak"), F.lit(0)).cast("long").alias("loss_streak")
    )


def floating(accounts: DataFrame) -> DataFrame:
    """F8: floating loss (balance - equity) and profit (equity - balance)."""
    return accounts.withColumn("floating_loss", F.col("balance") - F.col("equity")).withColumn(
        "floating_profit", F.col("equity") - F.col("balance")
    )


# --- rules ---------------------------------------------------------------------------------


def lot_size(streaks: DataFrame, info: DataFrame, cfg: StrategyConfig, streak_col: str = "loss_streak") -> DataFrame:
    """K1: martingale lot clamped to max_lot and the symbol's volume range (when known)."""
    raw = F.lit(cfg.initial_lot) * F.pow(F.lit(cfg.martingale_mult), F.col(streak_col).cast("double"))
    df = streaks.join(info, "symbol", "left")
    clamped = F.least(F.greatest(F.least(raw, F.lit(cfg.max_lot)), F.col("volume_min")), F.col("volume_max"))
    lot = F.when(F.col("volume_min").isNotNull(), clamped).otherwise(raw)
    return df.withColumn("lot", F.bround(lot, 2))


def max_risk_stop(accounts: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """K2: stop trading when floating loss >= max_risk % of balance."""
    limit = F.col("balance") * F.lit(cfg.max_risk_percent / 100.0)
    return floating(accounts).withColumn("risk_stop", F.coalesce(F.col("floating_loss") >= limit, F.lit(True)))


def side_price(type_col: str = "type") -> Column:
    """A BUY is marked at the bid, a SELL at the ask."""
    return F.when(F.col(type_col) == "BUY", F.col("bid")).otherwise(F.col("ask"))


def trailing_points(positions: DataFrame, ticks: DataFrame, info: DataFrame, distance: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """K3: move the SL to price ∓ distance once the gain in whole points reaches it,
    only when tighter than the stored SL (or none is set). ``keep``: further columns of the positions."""
    df = positions.join(ticks.select("symbol", "bid", "ask"), "symbol", "left").join(info, "symbol", "left")
    price = side_price()
    buy = F.col("type") == "BUY"
    gain = F.when(buy, price - F.col("price_open")).otherwise(F.col("price_open") - price)
    pts = whole_points(gain, F.col("point"))
    new_sl = F.when(buy, price - F.lit(distance) * F.col("point")).otherwise(price + F.lit(distance) * F.col("point"))
    tighter = (F.col("sl") == 0) | (buy & (new_sl > F.col("sl"))) | (~buy & (new_sl < F.col("sl")))
    move = F.coalesce((pts >= F.lit(distance)) & tighter, F.lit(False)) & F.lit(distance > 0)
    return df.select(
        "account_id", "ticket", "symbol", "type", price.alias("price_current"), pts.alias("gain_points"),
        F.when(move, round_digits(new_sl, F.col("digits"))).alias("new_sl"),
        F.when(move, F.when(F.col("tp") > 0, round_digits(F.col("tp"), F.col("digits"))).otherwise(F.lit(0.0))).alias("new_tp"),
        move.alias("move_sl"), *keep,
    )


def atr_trailing(positions: DataFrame, last_bar: DataFrame) -> DataFrame:
    """K4: SL = close ∓ 1.5·ATR (3 dp); BUY moves up past SL + 0.2·ATR, SELL down (or from unset)."""
    df = positions.join(last_bar.select("symbol", F.col("close").alias("_c"), "atr"), "symbol", "left")
    buy = F.col("type") == "BUY"
    atr = F.col("atr")
    new_sl = F.bround(F.when(buy, F.col("_c") - atr * 1.5).otherwise(F.col("_c") + atr * 1.5), 3)
    move = F.when(buy, new_sl > F.col("sl") + atr * 0.2).otherwise((F.col("sl") == 0) | (new_sl < F.col("sl") - atr * 0.2))
    move = F.coalesce(move, F.lit(False))
    return df.select("account_id", "ticket", "symbol", "type", F.when(move, new_sl).alias("new_sl"), move.alias("move_sl"))


def atr_stop_path(bars: DataFrame) -> DataFrame:
    """K4 over a bar history: the stop of a BUY and of a SELL held from the first bar with an ATR on.

    ``bars``: symbol, tf, n, close, atr. Each bar's candidate replaces the stop if it is tighter
    by 0.2 ATR, so stops build on one another; a series lies sorted in its partition and
    streams through the fold, which keeps one number.
    """
    buy = F.col("side") == "BUY"
    sides = bars.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL")))).filter(F.col("atr").isNotNull())
    rows = sides.select("symbol", "tf", "side", "n", "atr", F.bround(
        F.when(buy, F.col("close") - F.col("atr") * 1.5).otherwise(F.col("close") + F.col("atr") * 1.5), 3).alias("candidate"))

    def run(batches):
        key, stop = None, 0.0
        for pdf in batches:
            stops, moved = [], []
            for symbol, tf, side, atr, candidate in zip(pdf["symbol"], pdf["tf"], pdf["side"], pdf["atr"], pdf["candidate"]):
                if key != (symbol, tf, side):
                    key, stop = (symbol, tf, side), 0.0
                if side == "BUY":
                    move = candidate > stop + atr * 0.2
                else:
                    move = stop == 0 or candidate < stop - atr * 0.2
                stop = candidate if move else stop
                stops.append(stop)
                moved.append(move)
            out = pdf[["symbol", "tf", "side", "n"]].copy()
            out["stop"], out["moved"] = stops, moved
            yield out

    keys = ("symbol", "tf", "side")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n").mapInPandas(
        run, "symbol string, tf string, side string, n long, stop double, moved boolean")


def close_all(book: DataFrame, accounts: DataFrame, cfg: StrategyConfig, peak: str | None = None) -> DataFrame:
    """K5: close everything on profit >= % of balance, else >= $, else a pullback from the peak.

    ``book`` has one row per (account, symbol) with open positions; ``peak`` names the
    peak-profit column when a history is available (else the current profit is the peak).
    """
    df = book.join(floating(accounts), "account_id")
    fp = F.col("floating_profit")
    pct_thr = F.col("balance") * F.lit(cfg.close_all_percent / 100.0)
    by_pct = F.lit(cfg.close_all_percent > 0) & (fp >= pct_thr)
    by_usd = F.lit(cfg.close_all_dollar > 0) & (fp >= F.lit(cfg.close_all_dollar))
    pk = F.greatest(F.col(peak), fp) if peak else fp
    pull = F.when(pk > 0, (pk - fp) / pk * F.lit(100.0))
    by_pull = F.lit(cfg.close_all_pullback > 0) & F.coalesce(pull >= F.lit(cfg.close_all_pullback), F.lit(False))
    reason = (
        F.when(by_pct, F.concat(F.lit("profit "), decimal_text(fp, 2), F.lit(" >= "), decimal_text(pct_thr, 2)))
        .when(by_usd, F.concat(F.lit("profit "), decimal_text(fp, 2), F.lit(f" >= ${cfg.close_all_dollar}")))
        .when(by_pull, F.concat(F.lit("pullback "), decimal_text(pull, 1), F.lit("%")))
        .otherwise(F.lit(""))
    )
    return df.select("account_id", "symbol", fp.alias("floating_profit"), (by_pct | by_usd | by_pull).alias("close_all"), reason.alias("reason"))


def close_rules(positions: DataFrame, signals: DataFrame, cfg: StrategyConfig, signal_col: str = "signal") -> DataFrame:
    """K6 + K7: close on profit >= P or <= -L; else a winning position against the signal."""
    df = positions.join(signals.select("symbol", F.col(signal_col).alias("_sig")), "symbol", "left")
    p = F.col("profit")
    by_level = (p >= F.lit(cfg.close_profit)) | (p <= F.lit(-cfg.close_loss))
    against = ((F.col("type") == "BUY") & (F.col("_sig") == "BEARISH")) | ((F.col("type") == "SELL") & (F.col("_sig") == "BULLISH"))
    by_signal = ~by_level & (p > 0) & F.coalesce(against, F.lit(False))
    reason = F.when(by_level & (p >= F.lit(cfg.close_profit)), F.lit("take_profit")).when(
        by_level, F.lit("stop_loss")).when(by_signal, F.lit("signal_reversal")).otherwise(F.lit(""))
    return df.select("account_id", "ticket", "symbol", "type", "profit", F.col("_sig").alias("signal"),
                     (by_level | by_signal).alias("close"), reason.alias("reason"))


def sl_tp_levels(price: Column, side: Column, point: Column, sl_points: float, tp_points: float) -> tuple[Column, Column]:
    """K9: price ∓ points·point·100 (0 points → unset = 0)."""
    sl = F.lit(0.0) if sl_points == 0 else price - side * F.lit(sl_points) * point * F.lit(100.0)
    tp = F.lit(0.0) if tp_points == 0 else price + side * F.lit(tp_points) * point * F.lit(100.0)
    return sl, tp


def account_symbols(accounts: DataFrame, symbols: str) -> DataFrame:
    """Every account with every configured symbol; positions are not needed for a first order."""
    return accounts.select("account_id", F.explode(F.array_distinct(parse_symbols(F.lit(symbols)))).alias("symbol"))


def with_book(pairs: DataFrame, book: DataFrame) -> DataFrame:
    """E8 on counts: (account, symbol) pairs with their position counts and anchors, 0 without positions."""
    counts = ("n_buy", "n_sell", "grid_count")
    df = pairs.join(book, ["account_id", "symbol"], "left")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts} |
                          {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("buy_anchor", "sell_anchor")})


def martingale_lot(level: Column, cfg: StrategyConfig) -> Column:
    """K1 for a symbol with known volume limits."""
    raw = F.lit(cfg.initial_lot) * F.pow(F.lit(cfg.martingale_mult), level.cast("double"))
    return F.bround(clamp(F.least(raw, F.lit(cfg.max_lot)), "volume_min", "volume_max"), 2)


def grid_trigger(book: DataFrame, ticks: DataFrame, info: DataFrame, cfg: StrategyConfig, side: str) -> DataFrame:
    """K8: open a grid order when the price moved ``grid_distance`` points from the anchor.

    ``book`` has a row per (account, symbol), also without positions. No anchor → first grid
    order at the current price; stops at ``max_grid_orders`` positions of either side. Symbols
    without a quote or information are left out.
    """
    anchor = F.col("buy_anchor") if side == "BUY" else F.col("sell_anchor")
    price = F.col("ask") if side == "BUY" else F.col("bid")
    df = book.join(ticks.select("symbol", "bid", "ask"), "symbol").join(info, "symbol")
    dist = F.abs(price - anchor) / F.col("point")
    ok = F.lit(cfg.use_grid) & (F.col("grid_count") < F.lit(cfg.max_grid_orders)) & (
        (anchor == 0) | (dist >= F.lit(cfg.grid_distance))
    )
    same_side = F.col("n_buy") if side == "BUY" else F.col("n_sell")
    return df.select(
        "account_id", "symbol", F.lit(side).alias("side"), price.alias("price"), anchor.alias("anchor"),
        dist.alias("distance_points"), F.coalesce(ok, F.lit(False)).alias("open_grid"), same_side.alias("grid_level"),
        "point", "digits", "volume_min", "volume_max",
    )


def grid_intents(triggers: DataFrame, risk: DataFrame, cfg: StrategyConfig) -> DataFrame:
    """K8 orders: lot by the same side's position count, levels in points; none under the risk stop."""
    df = triggers.filter("open_grid").join(risk.select("account_id", "risk_stop"), "account_id", "left")
    df = df.filter(~F.coalesce(F.col("risk_stop"), F.lit(True)))
    direction = F.when(F.col("side") == "BUY", F.lit(1.0)).otherwise(F.lit(-1.0))
    sl, tp = sl_tp_levels(F.col("price"), direction, F.col("point"), cfg.sl_points if cfg.use_sl_tp else 0.0,
                          cfg.tp_points if cfg.use_sl_tp else 0.0)
    return df.select(
        "account_id", "symbol", F.lower("side").alias("action"), martingale_lot(F.col("grid_level"), cfg).alias("volume"),
        "price", round_digits(sl, F.col("digits")).alias("sl"), round_digits(tp, F.col("digits")).alias("tp"),
    )


def order_intents(decisions: DataFrame, info: DataFrame, ticks: DataFrame, streaks: DataFrame,
                  risk: DataFrame, cfg: StrategyConfig, magic: int = 0) -> DataFrame:
    """Per (account, symbol) signal → side cap → risk gate → order intent row.

    ``decisions``: account_id, symbol, signal (BULLISH/BEARISH/NEUTRAL), n_buy, n_sell, a row
    for every account and configured symbol. Symbols without information give no intent. Risk
    stop turns an open into a close-all intent (K13).
    """
    cap = cfg.max_per_side if cfg.use_grid else 1
    sig = F.col("signal")
    action = (
        F.when((sig == "BULLISH") & (F.col("n_buy") < F.lit(cap)), F.lit("buy"))
        .when((sig == "BEARISH") & (F.col("n_sell") < F.lit(cap)), F.lit("sell"))
    )
    df = (
        decisions.withColumn("_action", action)
        .filter(F.col("_action").isNotNull())
        .join(risk.select("account_id", "risk_stop"), "account_id", "left")
        .join(ticks.select("symbol", "bid", "ask"), "symbol", "left")
        .join(info, "symbol")
        .join(streaks.select("symbol", "loss_streak"), "symbol", "left")
    )
    side = F.when(F.col("_action") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    price = F.when(F.col("_action") == "buy", F.col("ask")).otherwise(F.col("bid"))
    lot = martingale_lot(F.coalesce(F.col("loss_streak"), F.lit(0)), cfg)
    sl, tp = sl_tp_levels(price, side, F.col("point"), cfg.sl_points if cfg.use_sl_tp else 0.0,
                          cfg.tp_points if cfg.use_sl_tp else 0.0)
    stop = F.coalesce(F.col("risk_stop"), F.lit(True))

    def unless_stopped(value: Column) -> Column:
        return F.when(~stop, value)

    return df.select(
        "account_id", "symbol",
        F.when(stop, F.lit("close_all")).otherwise(F.col("_action")).alias("action"),
        unless_stopped(lot).alias("volume"), unless_stopped(price).alias("price"),
        unless_stopped(round_digits(sl, F.col("digits"))).alias("sl"),
        unless_stopped(round_digits(tp, F.col("digits"))).alias("tp"),
        F.lit(magic).cast("long").alias("magic"),
        F.when(stop, F.lit("risk stop")).otherwise(F.concat(F.lit("auto "), F.col("signal"))).alias("comment"),
    )


def atr_levels(price: Column, side: Column, atr: Column, sl_mult: float, tp_mult: float) -> tuple[Column, Column]:
    """K9 by ATR: the stop ``sl_mult`` and the target ``tp_mult`` ATRs from the price."""
    return price - side * atr * F.lit(sl_mult), price + side * atr * F.lit(tp_mult)


def reversal_intents(pairs: DataFrame, open_pos: DataFrame, last_bar: DataFrame, ticks: DataFrame,
                     lot: float = 0.01, sl_mult: float = 2.0, tp_mult: float = 3.0) -> DataFrame:
    """K11 + E8: a gated signal (±1) against the open side closes it, then opens the new side.

    ``pairs``: account_id, symbol, magic, signal. The open side is that of the account's first
    position (lowest ticket) on (symbol, magic); without one the order only opens. A close
    takes the position's volume at the quote of its other side, an open ``lot`` at the last
    close with stop and target in ATRs.
    """
    key = ["account_id", "symbol", "magic"]
    first = open_pos.groupBy(*key).agg(
        F.min_by("type", "ticket").alias("_type"), F.min_by("volume", "ticket").alias("_volume"), F.min("ticket").alias("open_ticket"))
    df = pairs.join(first, key, "left").withColumn("current_side", side_code(F.coalesce(F.col("_type"), F.lit(""))))
    df = df.filter((F.col("signal") != 0) & (F.col("signal") != F.col("current_side")))
    df = df.join(last_bar.select("symbol", "close", "atr"), "symbol").join(ticks.select("symbol", "bid", "ask"), "symbol")
    new, old = F.col("signal"), F.col("current_side")
    sl, tp = atr_levels(F.col("close"), new.cast("double"), F.col("atr"), sl_mult, tp_mult)
    nothing = F.lit(None).cast("double")

    def side(code: Column) -> Column:
        return F.when(code > 0, F.lit("BUY")).otherwise(F.lit("SELL"))

    def step(action: str, where: Column, volume: Column, price: Column, sl: Column, tp: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), where.alias("side"), volume.alias("volume"), price.alias("price"),
                        sl.alias("sl"), tp.alias("tp"))

    close = step("close", side(-old), F.col("_volume"), F.when(old > 0, F.col("bid")).otherwise(F.col("ask")), nothing, nothing)
    open_ = step("open", side(new), F.lit(lot), F.col("close"), sl, tp)
    steps = F.when(old != 0, F.array(close, open_)).otherwise(F.array(open_))
    return df.select(*key, "signal", "current_side", "open_ticket", F.posexplode(steps).alias("step", "_s")).select(
        *key, "signal", "current_side", "open_ticket", "step", "_s.*")


def positions_for(positions: DataFrame, symbol: str | None = None, ticket: int | None = None,
                  magic: int | None = None) -> DataFrame:
    """Positions by symbol / ticket / magic (plain filters, pushed to the scan)."""
    cond = F.lit(True)
    if symbol is not None:
        cond = cond & (F.col("symbol") == symbol)
    if ticket is not None:
        cond = cond & (F.col("ticket") == ticket)
    if magic is not None:
        cond = cond & (F.col("magic") == magic)
    return positions.filter(cond)


def configured_symbols(spark, text: str) -> DataFrame:
    """A10: the configured ``"A, B"`` list as a one-column table (one row per symbol)."""
    return spark.createDataFrame([(text,)], "symbols string").select(
        F.explode(parse_symbols(F.col("symbols"))).alias("symbol")).distinct()


def restrict_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Keep rows of configured symbols (left semi join)."""
    return df.join(symbols, "symbol", "left_semi")
