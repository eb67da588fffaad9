"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver tables (or bars Spark derives from them) over their whole extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import class_text, clock_text, money_text, pl_sign
from ..operators import backtest as BT
from ..operators import boosting as BO
from ..operators import features as FE
from ..operators import indicators as I
from ..operators import joins as JN
from ..operators import labels as LB
from ..operators import ml as ML
from ..operators import recurrence
from ..operators import risk as RK
from ..operators import signals as SG
from ..operators.series import KEYS, number_bars, number_rows, rolling
from ..session import cut_lineage, prepare
from ..sources import bars as B
from ..sources import fixtures as FX
from ..streaming import bars_stream as ST
from ..streaming import signals_stream as SS
from ..streaming import stops_stream as SP
from .report import rounded

BAR_COLS = ["symbol", "tf", "time", "n"]


def _numbered(bars: DataFrame) -> DataFrame:
    """Numbered bars as a table: what follows reads it several times, the ticks are read once.

    Numbering reads the bars twice (to count and to number them), so they are a table before it too.
    """
    return cut_lineage(number_bars(cut_lineage(bars, "unnumbered")), "bars")


def _li(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return _numbered(B.lineitem_bars(spark, sf))


# --- A: sources -----------------------------------------------------------------------------


def q_bars_lineitem_d1(spark, sf):
    prepare(spark)
    return rounded(B.lineitem_bars(spark, sf))


def q_bars_orders_d1(spark, sf):
    prepare(spark)
    return rounded(B.orders_bars(spark, sf))


def q_bars_events_m15(spark, sf):
    prepare(spark)
    return rounded(B.events_bars(spark, sf, "M15"))


def q_bars_rollup_m15_h4(spark, sf):
    prepare(spark)
    return rounded(B.rollup_bars(B.events_bars(spark, sf, "M15"), "H4"))


def q_last_300_bars(spark, sf):
    prepare(spark)
    return rounded(B.last_n_bars(B.lineitem_bars(spark, sf), 300))


def q_last_7000_bars(spark, sf):
    """A1 with more bars than a group limit covers, on the long minute tape."""
    prepare(spark)
    return rounded(B.last_n_bars(B.tape_bars(spark, sf), 7000))


def q_latest_tick(spark, sf):
    prepare(spark)
    t = B.latest_tick(B.events_ticks(spark, sf))
    return rounded(t.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


# --- C: indicators ---------------------------------------------------------------------------


def q_ind_sma(spark, sf):
    df = rolling(
        _li(spark, sf),
        lambda w: [(f"sma_{p}", I.sma("close", p, w)) for p in (10, 30, 200)],
        back=199,
    )
    return rounded(df.select(*BAR_COLS, "sma_10", "sma_30", "sma_200"))


EMA_PERIODS = (2, 9, 12, 21, 26, 200)


def q_ind_ema(spark, sf):
    df = recurrence.run(_li(spark, sf), [I.ema_rec(f"ema_{p}", "close", p) for p in EMA_PERIODS])
    cols = [I.valid_from(F.col(f"ema_{p}"), p - 1).alias(f"ema_{p}") for p in EMA_PERIODS]
    return rounded(df.select(*BAR_COLS, *cols))


def q_ind_ema_history(spark, sf):
    """C2 as a poll of a fixed number of bars computes it: EMA(200) of 200 bars, EMA(12) and EMA(26) of 60."""
    df = rolling(_li(spark, sf), lambda w: [
        ("ema_200_of_200", I.ema_history("close", 200, 200, w)), ("ema_12_of_60", I.ema_history("close", 12, 60, w)),
        ("ema_26_of_60", I.ema_history("close", 26, 60, w))], back=199)
    return rounded(df.select(*BAR_COLS, "ema_200_of_200", "ema_12_of_60", "ema_26_of_60"))


def q_ind_bbands(spark, sf):
    df = I.with_bbands(_li(spark, sf))
    return rounded(df.select(*BAR_COLS, "bb_upper", "bb_middle", "bb_lower"))


def q_ind_macd(spark, sf):
    df = recurrence.run(_li(spark, sf), I.macd_recs("close", 12, 26, "macd") + I.macd_recs("close", 11, 27, "macd4"))
    df = I.macd_finish(df, 12, 26, 9, "macd")
    df = I.macd_finish(df, 11, 27, 4, "macd4")
    return rounded(df.select(*BAR_COLS, "macd", "macd_signal", "macd_hist", "macd4", "macd4_signal", "macd4_hist"))


def q_ind_rsi(spark, sf):
    return rounded(I.with_rsi(_li(spark, sf)).select(*BAR_COLS, "rsi_14"))


def q_ind_atr(spark, sf):
    return rounded(I.with_atr(_li(spark, sf), natr="natr").select(*BAR_COLS, "atr", "natr"))


def q_ind_adx(spark, sf):
    return rounded(I.with_adx(_li(spark, sf)).select(*BAR_COLS, "adx"))


def q_ind_adx_flat(spark, sf):
    """C9 on bars whose price stands still from bar 200 on: the last defined value stays."""
    flat = {c: F.when(F.col("n") >= 200, F.lit(100.0)).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return rounded(I.with_adx(_li(spark, sf).withColumns(flat)).select(*BAR_COLS, "adx"))


def q_ind_long_m1(spark, sf):
    """C1, C2, C7, C9 on the long minute tape: many blocks, carries over several levels."""
    prepare(spark)
    df = recurrence.run(_numbered(B.tape_bars(spark, sf)), [I.ema_rec("ema_12", "close", 12), I.ema_rec("ema_200", "close", 200)])
    df = I.with_adx(I.with_atr(df))
    df = rolling(df, lambda w: I.long_sma("sma_200", "close", 200, w), back=199)
    return rounded(df.select(*BAR_COLS, I.valid_from(F.col("ema_12"), 11).alias("ema_12"),
                             I.valid_from(F.col("ema_200"), 199).alias("ema_200"), "atr", "adx", "sma_200"))


def q_ind_mfi(spark, sf):
    return rounded(I.with_mfi(_li(spark, sf)).select(*BAR_COLS, "mfi"))


def q_ind_linreg_slope(spark, sf):
    df = rolling(
        _li(spark, sf),
        lambda w: [("slope_20", I.linreg_slope("close", 20, w)), ("slope_30", I.linreg_slope("close", 30, w))],
        back=29,
    )
    return rounded(df.select(*BAR_COLS, "slope_20", "slope_30"))


def q_ind_rolling(spark, sf):
    def build(w):
        return [
            ("mean_5", I.sma("close", 5, w)),
            ("std_10", I.rolling_std("close", 10, w)),
            ("prev_close", I.lag("close", 1, w)),
            ("pct_1", I.pct_change("close", 1, w)),
            ("pct_3", I.pct_change("close", 3, w)),
            ("close_lead_5", I.lead("close", 5, w)),
        ]

    df = rolling(_li(spark, sf), build, back=9, fwd=5)
    return rounded(df.select(*BAR_COLS, "mean_5", "std_10", "prev_close", "pct_1", "pct_3", "close_lead_5"))


# --- D/G: feature sets and labels -------------------------------------------------------------



def _feature_query(spark, sf, feature_set):
    df = FE.build_features(_li(spark, sf), feature_set)
    cols = [*BAR_COLS, *FE.feature_columns(feature_set)]
    if "label" in df.columns:
        cols += ["label", "label_valid"]
    return rounded(df.select(*cols))


def q_features_v11(spark, sf):
    return _feature_query(spark, sf, "v11")


def q_features_v10(spark, sf):
    return _feature_query(spark, sf, "v10")


def q_features_momentum25(spark, sf):
    return _feature_query(spark, sf, "momentum25")


def q_features_session30(spark, sf):
    """D17-D21 + G3 on events M15 bars with H1 bars of the same symbols."""
    prepare(spark)
    m15 = _numbered(B.events_bars(spark, sf, "M15"))
    h1 = B.events_bars(spark, sf, "H1")
    df = FE.session30_features(m15, h1)
    return rounded(df.select(*BAR_COLS, *FE.SESSION30_COLUMNS, *FE.HTF_COLUMNS, "label"))


def q_features_simple4(spark, sf):
    return _feature_query(spark, sf, "simple4")


def q_labels_triple_barrier(spark, sf):
    df = rolling(_li(spark, sf), lambda w: LB.triple_barrier_label_cols(w, 10, 0.01, 0.008), back=0, fwd=10)
    return df.select(*BAR_COLS, "label")


# --- H: signals -------------------------------------------------------------------------------


def q_strategy_signals(spark, sf):
    df = SG.strategy_signals(_li(spark, sf))
    return rounded(df.select(
        *BAR_COLS, "macd_state", "ema_signal", "rsi_signal", "bb_signal", "bb_reason", "trend",
        "trend_reason", "sideways", "macd_zero", "combined", "trend_combined",
    ))


#: Strategy per symbol of the walks.
WALK_STRATEGIES = {"W0": "ai", "W1": "bb", "W2": "rules"}


def q_signals_walk(spark, sf):
    """H1-H8, H13 and H14 by symbol on price walks, where trends, ranges and crossings all occur."""
    prepare(spark)
    df = FX.with_predictions(SG.strategy_signals(_numbered(B.walk_bars(spark, sf))))
    df = df.withColumn("ai_signal", class_text(SG.model_class(SG.prob_array())))
    strategy = F.create_map(*[F.lit(x) for pair in WALK_STRATEGIES.items() for x in pair])[F.col("symbol")]
    return df.select(*BAR_COLS, "macd_state", "ema_signal", "rsi_signal", "bb_signal", "trend", "sideways", "macd_zero",
                     "combined", "trend_combined", SG.choose_by_symbol(strategy).alias("decision"))


def q_model_signal_gates(spark, sf):
    """H9-H11 on V11 features with the deterministic probability stand-in."""
    feats = FE.build_features(_li(spark, sf), "v11", with_label=False)
    probs = SG.prob_array()
    df = FX.with_predictions(feats)
    cls = SG.model_class(probs)
    gated = SG.confidence_gate(probs, 0.54)
    return rounded(df.select(
        *BAR_COLS,
        cls.alias("model_class"),
        F.when(F.col("n") < 60, F.lit("NEUTRAL")).otherwise(
            F.when(cls == 1, "BULLISH").when(cls == -1, "BEARISH").otherwise("NEUTRAL")).alias("ai_signal"),
        gated.alias("gated"),
        SG.slope_gate_backtest(gated).alias("gated_backtest"),
        SG.slope_gate_live(gated).alias("gated_live"),
    ))


# --- I1/J: backtests ----------------------------------------------------------------------------


def _feature_rows(spark, sf, feature_set, columns):
    """Labelled feature rows with the asked-for columns only, written once for what reads them again."""
    feats = FE.build_features(_li(spark, sf), feature_set).filter(F.col("label_valid"))
    return cut_lineage(feats.select(*BAR_COLS, "close", "label", *columns), "feature_rows")


def _v11_test_frame(spark, sf, threshold=0.54):
    feats = _feature_rows(spark, sf, "v11", ["slope_20", "adx"])
    split = BT.chronological_split(feats)
    probs = SG.prob_array()
    test = FX.with_predictions(split).filter(F.col("t").isNotNull())
    test = test.withColumn("prediction", SG.confidence_gate(probs, threshold))
    return test.withColumn("signal", SG.slope_gate_backtest(F.col("prediction")))


def q_backtest_bar_to_bar(spark, sf):
    test = _v11_test_frame(spark, sf)
    curve = BT.equity_curves(BT.bar_to_bar(test))
    return rounded(curve.select(*BAR_COLS, "t", "prediction", "signal", "ret", "cost", "strat_ret", "equity", "equity_bh"))


def q_backtest_v10(spark, sf):
    """J1 with the V10.1 settings: confidence 0.52, fixed slope limit."""
    split = BT.chronological_split(_feature_rows(spark, sf, "v10", ["slope_30"]))
    test = FX.with_predictions(split).filter(F.col("t").isNotNull())
    test = test.withColumn("prediction", SG.confidence_gate(SG.prob_array(), 0.52))
    gated = SG.slope_gate_backtest(F.col("prediction"), slope="slope_30", limit=F.lit(SG.V10_SLOPE_LIMIT))
    curve = BT.equity_curves(BT.bar_to_bar(test.withColumn("signal", gated)))
    return rounded(curve.select(*BAR_COLS, "t", "prediction", "signal", "ret", "cost", "strat_ret", "equity", "equity_bh"))


def q_backtest_tables(spark, sf):
    """A backtest written as tables and read back."""
    import os

    from ..session import ensure_checkpoint_dir
    from ..sources import sinks

    curve = BT.equity_curves(BT.bar_to_bar(_v11_test_frame(spark, sf)))
    base = os.path.join(ensure_checkpoint_dir(spark), "backtests", os.urandom(8).hex())
    paths = sinks.write_backtest(curve, base, "v11")
    read = spark.read.parquet(paths["equity"])
    return rounded(read.select("symbol", "tf", "time", "t", "ret", "strat_ret", "equity", "equity_bh", F.col("run_id").cast("string")))


def q_log_written(spark, sf):
    """Log lines appended day by day and read back, lines by level."""
    import os

    from ..session import ensure_checkpoint_dir
    from ..sources import sinks

    prepare(spark)
    path = os.path.join(ensure_checkpoint_dir(spark), "logs", os.urandom(8).hex())
    lines = FX.event_log(spark, sf)
    for level in ("success", "error", "info"):
        sinks.append_log(lines.filter(F.col("level") == level), path)
    return spark.read.parquet(path).groupBy("date", "level").agg(F.count(F.lit(1)).alias("n_lines"))


def q_backtest_summary(spark, sf):
    test = _v11_test_frame(spark, sf)
    res = BT.summary(BT.bar_to_bar(test), test, signal="prediction")
    return rounded(res)


def _m25_test_frame(spark, sf, threshold=None):
    feats = cut_lineage(FE.build_features(_li(spark, sf), "momentum25").select(*BAR_COLS, "high", "low", "close"), "feature_rows")
    split = BT.chronological_split(feats)
    probs = SG.prob_array()
    test = FX.with_predictions(split).filter(F.col("t").isNotNull())
    sig = SG.model_class(probs) if threshold is None else SG.confidence_gate(probs, threshold)
    return test.withColumn("signal", sig)


def q_backtest_horizon(spark, sf):
    curve = BT.equity_curves(BT.horizon_returns(_m25_test_frame(spark, sf)))
    return rounded(curve.select(*BAR_COLS, "t", "signal", "ret", "strat_ret", "equity", "equity_bh"))


def q_backtest_tp_sl(spark, sf):
    curve = BT.equity_curves(BT.tp_sl_returns(_m25_test_frame(spark, sf, threshold=0.40)))
    return rounded(curve.select(*BAR_COLS, "t", "signal", "ret", "strat_ret", "equity", "equity_bh"))


# --- E/F/K: joins, account aggregates and risk rules -------------------------------------------


CFG = RK.StrategyConfig()


def _last_bar(df):
    """Newest row per symbol (partial aggregate on a struct)."""
    cols = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*cols), "n").alias("_r")).select("symbol", "_r.*")


def q_position_book(spark, sf):
    prepare(spark)
    return rounded(RK.position_book(FX.positions(spark, sf)))


def q_loss_streaks(spark, sf):
    prepare(spark)
    return RK.loss_streaks(FX.closed_trades(spark, sf))


def q_lot_size(spark, sf):
    prepare(spark)
    streaks = RK.loss_streaks(FX.closed_trades(spark, sf))
    info = FX.symbol_info(B.lineitem_bars(spark, sf))
    return rounded(RK.lot_size(streaks, info, CFG).select("symbol", "loss_streak", "lot"))


def q_max_risk(spark, sf):
    prepare(spark)
    return rounded(RK.max_risk_stop(FX.accounts(spark, sf), CFG))


def q_trailing_points(spark, sf):
    prepare(spark)
    quotes = B.latest_quote(B.order_ticks(spark, sf))
    info = FX.symbol_info(B.orders_bars(spark, sf))
    return rounded(RK.trailing_points(FX.positions(spark, sf), quotes, info, distance=300.0))


def q_atr_trailing(spark, sf):
    prepare(spark)
    bars = I.with_atr(_numbered(B.orders_bars(spark, sf)))
    last = _last_bar(bars.select("symbol", "n", "close", "atr"))
    return rounded(RK.atr_trailing(FX.positions(spark, sf), last))


def q_close_all(spark, sf):
    prepare(spark)
    pos = FX.positions(spark, sf)
    cfg = RK.StrategyConfig(close_all_percent=0.1, close_all_dollar=5.0, close_all_pullback=20.0)
    return rounded(RK.close_all(RK.position_book(pos), FX.accounts(spark, sf, pos), cfg))


def _orders_signal(spark, sf):
    sig = SG.strategy_signals(_numbered(B.orders_bars(spark, sf)))
    return _last_bar(sig.select("symbol", "n", F.col("combined").alias("signal")))


def q_close_rules(spark, sf):
    prepare(spark)
    return rounded(RK.close_rules(FX.positions(spark, sf), _orders_signal(spark, sf), CFG))


def q_close_rules_walk(spark, sf):
    """K6 + K7 on positions with small profits, so that the signal's rule is reached as well."""
    prepare(spark)
    pos = FX.positions(spark, sf).withColumn("profit", (F.col("ticket") % 61 - 30).cast("double"))
    signals = _orders_ai_signal(B.latest_quote(B.order_ticks(spark, sf)))
    return rounded(RK.close_rules(pos, signals, CFG))


def q_atr_trailing_walk(spark, sf):
    """K4 on positions whose stops lie on both sides of the price."""
    prepare(spark)
    near = F.col("price_current") * (F.lit(1.0) + (F.col("ticket") % 13 - 6).cast("double") / F.lit(3.0))
    pos = FX.positions(spark, sf).withColumn("sl", near)
    bars = I.with_atr(_numbered(B.orders_bars(spark, sf)))
    return rounded(RK.atr_trailing(pos, _last_bar(bars.select("symbol", "n", "close", "atr"))))


def q_atr_stop_path(spark, sf):
    """K4 as a running stop over every bar of every series, for both sides."""
    return rounded(RK.atr_stop_path(I.with_atr(_li(spark, sf)).select("symbol", "tf", "n", "close", "atr")))


#: The configured symbols of the order queries; the last one has no quote and no information.
SYMBOLS = "1-URGENT, 2-HIGH, 3-MEDIUM, 4-NOT SPECIFIED, 5-LOW, 9-UNLISTED"


def _account_side(spark, sf):
    """(positions, accounts, book of every account and configured symbol, quotes, symbol information)."""
    pos = FX.positions(spark, sf)
    accounts = FX.accounts(spark, sf, pos)
    book = RK.with_book(RK.account_symbols(accounts, SYMBOLS), RK.position_book(pos))
    quotes = B.latest_quote(B.order_ticks(spark, sf))
    return pos, accounts, book, quotes, FX.symbol_info(quotes)


def _grid(spark, sf, cfg):
    _, accounts, book, quotes, info = _account_side(spark, sf)
    both = [RK.grid_trigger(book, quotes, info, cfg, side) for side in ("BUY", "SELL")]
    return accounts, both[0].unionByName(both[1])


def q_grid_trigger(spark, sf):
    prepare(spark)
    out = _grid(spark, sf, RK.StrategyConfig(use_grid=True))[1]
    return rounded(out.drop("point", "digits", "volume_min", "volume_max"))


def q_grid_intents(spark, sf):
    """K8 + K1 + K2 + K9: grid orders of all accounts and configured symbols."""
    prepare(spark)
    cfg = RK.StrategyConfig(use_grid=True, sl_points=20.0, tp_points=40.0)
    accounts, triggers = _grid(spark, sf, cfg)
    return rounded(RK.grid_intents(triggers, RK.max_risk_stop(accounts, cfg), cfg))


def _orders_ai_signal(quotes):
    """H9 + H14 with the default config (use_ai): the model class per symbol as text."""
    cls = SG.model_class(SG.prob_array())
    return FX.symbol_predictions(quotes.select("symbol")).select("symbol", class_text(cls).alias("signal"))


def q_order_intents(spark, sf):
    """K10-K13 over accounts x configured symbols, with or without a position."""
    prepare(spark)
    _, accounts, book, quotes, info = _account_side(spark, sf)
    decisions = book.join(_orders_ai_signal(quotes), "symbol")
    streaks = RK.loss_streaks(FX.closed_trades(spark, sf, "o_orderpriority"))
    cfg = RK.StrategyConfig(sl_points=20.0, tp_points=40.0)
    return rounded(RK.order_intents(decisions, info, quotes, streaks, RK.max_risk_stop(accounts, cfg), cfg))


def q_reversal_intents(spark, sf):
    """E8 + K11 + K9 by ATR over accounts x configured symbols, for one magic number."""
    prepare(spark)
    pos, accounts, _, quotes, _ = _account_side(spark, sf)
    gated = SG.confidence_gate(SG.prob_array(), 0.54)
    sig = FX.symbol_predictions(quotes.select("symbol")).select("symbol", gated.alias("signal"))
    pairs = RK.account_symbols(accounts, SYMBOLS).join(sig, "symbol").withColumn("magic", F.lit(1).cast("long"))
    last = _last_bar(I.with_atr(_numbered(B.orders_bars(spark, sf))).select("symbol", "n", "close", "atr"))
    return rounded(RK.reversal_intents(pairs, pos, last, quotes))


def q_loss_streaks_by_supplier(spark, sf):
    """F10/F11 over many symbols: streaks of all lengths."""
    prepare(spark)
    return RK.loss_streaks(FX.closed_trades(spark, sf, "l_suppkey"))


def q_lot_size_by_supplier(spark, sf):
    prepare(spark)
    streaks = RK.loss_streaks(FX.closed_trades(spark, sf, "l_suppkey"))
    return rounded(RK.lot_size(streaks, FX.symbol_info(streaks), CFG).select("symbol", "loss_streak", "lot"))


def q_class_distribution(spark, sf):
    feats = FE.build_features(_li(spark, sf), "v11").filter(F.col("label_valid"))
    return feats.groupBy("symbol", "tf", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def q_confusion_metrics(spark, sf):
    """F6/F7 of the probability stand-in against the V11 labels (zero_division = 0)."""
    feats = FE.build_features(_li(spark, sf), "v11").filter(F.col("label_valid"))
    df = FX.with_predictions(feats).withColumn("pred", SG.model_class(SG.prob_array()))
    from ..operators import metrics as MT

    return rounded(MT.classification_report(df, "label", "pred", keys=("symbol", "tf")))


def q_asof_h1_to_m15(spark, sf):
    """E1 + D18: M15 bars with the previous closed H1 bar's RSI/close within 15 minutes."""
    prepare(spark)
    m15 = B.events_bars(spark, sf, "M15")
    h1 = I.with_rsi(_numbered(B.events_bars(spark, sf, "H1")))
    h1 = rolling(h1, lambda w: [("h1_rsi", F.lag("rsi_14", 1).over(w)), ("h1_close", F.lag("close", 1).over(w))], back=1)
    right = h1.select("symbol", "time", "h1_rsi", "h1_close")
    j = JN.asof_backward(m15.select("symbol", "tf", "time", "close"), right, tolerance_seconds=900)
    return rounded(j.select(
        "symbol", "tf", "time", "close", F.col("r_time").alias("h1_time"),
        F.coalesce(F.col("r_h1_rsi"), F.lit(50.0)).alias("h1_rsi"),
        F.coalesce(F.col("r_h1_close"), F.lit(0.0)).alias("h1_close"),
    ))


def q_status_snapshot(spark, sf):
    """Account figures rounded to 2 places with each open position as a formatted JSON
    row. One row per position (accounts without positions get one row with a null ticket):
    no per-account list is assembled, so an account with millions of positions stays spread
    over tasks; a consumer groups by ``account_id`` to render the list."""
    from ..functions.scalar import price_text

    prepare(spark)
    pos = FX.positions(spark, sf)
    acc = FX.accounts(spark, sf, pos)
    counts = pos.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_positions"))
    rows = pos.select("account_id", "ticket", F.to_json(F.struct(
        "ticket", "symbol", "type", "volume",
        price_text("price_open").alias("price_open"), price_text("sl").alias("sl"), price_text("tp").alias("tp"),
        F.bround("profit", 2).alias("profit"),
    )).alias("position_json"))
    out = acc.join(counts, "account_id", "left").join(rows, "account_id", "left").select(
        "account_id",
        F.bround("balance", 2).alias("balance"), F.bround("equity", 2).alias("equity"),
        F.bround("profit", 2).alias("profit"),
        F.coalesce(F.col("n_positions"), F.lit(0)).alias("n_positions"),
        "ticket", "position_json",
    )
    return rounded(out)


def q_event_log_tail(spark, sf):
    """A11 view: the newest 50 log lines (the limit is the feature)."""
    prepare(spark)
    return FX.event_log(spark, sf).orderBy(F.col("ts").desc(), "symbol", "msg").limit(50)


# --- flagship ----------------------------------------------------------------------------------


def q_flagship(spark, sf):
    """Minimum slice: lineitem D1 bars → EMA(12/26) via the recurrence kernel → H2 side →
    chronological test tail → J1 bar-to-bar returns → J6 summary per symbol."""
    df = recurrence.run(_li(spark, sf), [I.ema_rec("ema_12", "close", 12), I.ema_rec("ema_26", "close", 26)])
    df = df.withColumn("ema_12", I.valid_from(F.col("ema_12"), 11)).withColumn("ema_26", I.valid_from(F.col("ema_26"), 25))
    side = SG.ema_side()
    df = df.withColumn("signal", F.when(side == "BULLISH", 1).when(side == "BEARISH", -1).otherwise(0))
    test = BT.chronological_split(df).filter(F.col("t").isNotNull())
    return rounded(BT.summary(BT.bar_to_bar(test), test))


# --- I: machine learning (rows-only check) -----------------------------------------------------



def q_ml_ensemble_v11(spark, sf):
    """Train on the chronological head, score the test tail (pooled model)."""
    feats = _feature_rows(spark, sf, "v11", FE.V11_COLUMNS)
    split = BT.chronological_split(feats)
    train = ML.balanced_weights(split.filter(F.col("t").isNull()))
    model = ML.fit_ensemble(train, FE.V11_COLUMNS, ML.EnsembleParams(rf_trees=20, gbt_iter=8))
    test = split.filter(F.col("t").isNotNull())
    if model is None:
        return test.select(*BAR_COLS, "label").withColumn("pred", F.lit(0))
    scored = model.predict(test)
    gated = SG.confidence_gate(F.col("probs"), 0.54)
    return scored.select(*BAR_COLS, "label", "pred", gated.alias("gated"),
                         *[F.col("probs")[i].alias(n) for i, n in enumerate(("p_sell", "p_hold", "p_buy"))])


def _v11_train(spark, sf):
    split = BT.chronological_split(_feature_rows(spark, sf, "v11", FE.V11_COLUMNS))
    return split.filter(F.col("t").isNull())


def q_ml_class_weights(spark, sf):
    """I1 + I4: balanced class weights of the training rows."""
    train = ML.balanced_weights(_v11_train(spark, sf))
    return rounded(train.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.min("weight").alias("weight")))


def q_ml_scaler_v11(spark, sf):
    """I2 + F12: mean and deviation of every feature, read from the fitted preparation."""
    return rounded(ML.scaler_table(ML.preparation(_v11_train(spark, sf), FE.V11_COLUMNS), FE.V11_COLUMNS))


#: Sizes of the softmax boosters whose trees SQL grows as well; ``BoostParams()`` has the original ones.
SMALL_BOOST = BO.BoostParams(rounds=4, depth=3, eta=0.3, subsample=1.0)


def _probs(df, *cols):
    """``cols``, the class and the three probabilities of rows with ``probs``."""
    names = ("p_sell", "p_hold", "p_buy")
    return df.select(*cols, SG.model_class(F.col("probs")).alias("pred"), *[F.col("probs")[i].alias(n) for i, n in enumerate(names)])


def _fit_small(rows, features):
    """One small booster per ``model``, on bins of equal width; all rows scored."""
    models = rows.select("model").distinct()
    return BO.fit(rows.select("model", "id", "label", "weight", *features), features, BO.with_params(models, SMALL_BOOST), BO.width_edges, bins=16)


def _scored(rows, model):
    """``rows`` with the probabilities of their fitted model."""
    return rows.join(model.scored_rows().select("model", "id", "probs"), ["model", "id"])


def q_ml_softmax_by_symbol(spark, sf):
    """A softmax booster per symbol with explicit class weights, scoring the test tail."""
    split = BT.chronological_split(_feature_rows(spark, sf, "v11", FE.V11_COLUMNS))
    rows = ML.explicit_weights(split).withColumn("weight", F.when(F.col("t").isNull(), F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("model", F.col("symbol")).withColumn("id", F.col("n"))
    scored = _scored(rows.where(F.col("t").isNotNull()), _fit_small(rows, FE.V11_COLUMNS))
    return rounded(_probs(scored, *BAR_COLS, "t", "label"))


def q_ml_softmax_suppliers(spark, sf):
    """Every supplier a symbol with a model of its own, all in one fit; saved, loaded and used on the test tails."""
    prepare(spark)
    feats = FE.build_features(_numbered(B.lineitem_bars(spark, sf, "l_suppkey")), "simple4")
    feats = rolling(feats, lambda w: LB.horizon_label_cols("close", w), back=0, fwd=5)
    split = BT.chronological_split(cut_lineage(feats.select(*BAR_COLS, "label", *FE.SIMPLE4_COLUMNS), "feature_rows"))
    rows = cut_lineage(split, "split").withColumns({"model": F.col("symbol"), "id": F.col("n"), "weight": F.lit(1.0)})
    fitted = _fit_small(rows.where(F.col("t").isNull()), FE.SIMPLE4_COLUMNS)
    tails = rows.where(F.col("t").isNotNull())
    probs = BO.Boosted.load(spark, fitted.path).predict(tails)
    return rounded(_probs(tails.join(probs, ["model", "id"]), *BAR_COLS, "t", "label"))


def _walk_forward(spark, sf, n_folds=5):
    """Every slice after the first scored by a model of the rows before it: folds and symbols in one fit."""
    feats = _feature_rows(spark, sf, "v11", FE.V11_COLUMNS)
    rows = number_rows(feats, list(KEYS), "n", out="m").withColumn("weight", F.lit(1.0))
    folds = cut_lineage(BO.fold_rows(rows, n_folds), "folds")
    folds = folds.withColumns({"model": F.concat_ws("|", "symbol", F.col("fold").cast("string")), "id": F.col("n")})
    return _scored(folds.where("weight = 0"), _fit_small(folds, FE.V11_COLUMNS))


def q_ml_walk_forward(spark, sf):
    """I7 + I3: probabilities of the walk-forward models, by bar."""
    return rounded(_probs(_walk_forward(spark, sf), *BAR_COLS, "fold", "label"))


def q_backtest_walk_forward(spark, sf):
    """Train, score, gate and backtest in one path: J1, J4 and J5 on the signals of walk-forward models."""
    scored = cut_lineage(_walk_forward(spark, sf), "walk_forward")
    test = number_rows(scored, list(KEYS), "n", out="t")
    test = test.withColumn("prediction", SG.confidence_gate(F.col("probs"), 0.54))
    test = test.withColumn("signal", SG.slope_gate_backtest(F.col("prediction")))
    curve = BT.equity_curves(BT.bar_to_bar(test))
    return rounded(curve.select(*BAR_COLS, "t", "fold", "prediction", "signal", "ret", "cost", "strat_ret", "equity", "equity_bh"))


def q_ml_importances(spark, sf):
    """Features by their share of the gains, per symbol."""
    split = BT.chronological_split(_feature_rows(spark, sf, "v11", FE.V11_COLUMNS)).where(F.col("t").isNull())
    rows = split.withColumns({"model": F.col("symbol"), "id": F.col("n"), "weight": F.lit(1.0)})
    return rounded(_fit_small(rows, FE.V11_COLUMNS).importances().withColumnRenamed("model", "symbol"))


# The original search's learning rates and shares of rows and features. Rounds (100 to 500) and depths (3 to 7) are smaller.
SEARCH_GRID = {"rounds": (1, 2, 3), "depth": (2, 3), "eta": (0.01, 0.05, 0.1), "subsample": (0.8, 0.9, 1.0), "colsample": (0.8, 0.9, 1.0)}


def q_ml_random_search(spark, sf):
    """20 draws x 5 expanding-window folds per symbol, macro-F1 of each, mean score and rank; all in one fit."""
    n_draws, n_folds = ML.REFERENCE_SEARCH["gpu"]
    split = BT.chronological_split(_feature_rows(spark, sf, "v11", FE.V11_COLUMNS)).where(F.col("t").isNull())
    rows = split.withColumns({"id": F.col("n"), "weight": F.lit(1.0)})
    candidates = BO.draws(SEARCH_GRID, n_draws)
    scores = cut_lineage(BO.search(rows, FE.V11_COLUMNS, candidates, n_folds, bins=16), "search")
    best = BO.best_draws(scores).select(*KEYS, F.col("draw").alias("best"))
    sizes = BO.params_table(spark, {str(i): p for i, p in enumerate(candidates)}).withColumn("draw", F.col("model").cast("int"))
    out = scores.join(best, list(KEYS)).join(sizes.select("draw", "rounds", "depth", "eta", "subsample", "colsample"), "draw")
    return rounded(out.withColumn("is_best", F.col("draw") == F.col("best")).drop("best"))


# --- L: streaming ----------------------------------------------------------------------------


def q_stream_bars_m15(spark, sf):
    """L1: M15 bars from the events stream, closed windows only (1 hour watermark)."""
    prepare(spark)
    return rounded(_stream_bars_m15(spark, sf))


def _stream_bars_m15(spark, sf):
    """Ticks arrive in time order whatever the table's files hold, so the watermark drops none."""
    slices = _time_slices(ST.ticks(spark, sf), "ts")
    return ST.run_slices(spark, slices, lambda s: ST.tick_bars(s, 900, "1 hour", "M15"), "bars_m15")


def _time_slices(df, ts):
    """Four slices of a table that follow one another in time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.select(F.percentile_approx(at, [0.25, 0.5, 0.75])).first()[0] or []
    bounds = [None, *cuts, None]
    return [df.filter((F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi))
            for lo, hi in zip(bounds, bounds[1:])]


def q_stream_trade_state(spark, sf):
    """L3: per-symbol loss streak as keyed streaming state, over slices that arrive in time order."""
    prepare(spark)
    slices = _time_slices(FX.closed_trades(spark, sf, "l_suppkey"), "closed_at")
    out = ST.run_slices(spark, slices, ST.keyed_trade_state, "trade_state")
    newest = out.groupBy("symbol").agg(F.max("n_seen").alias("n_seen"), F.max_by("loss_streak", "n_seen").alias("loss_streak"))
    return newest.select("symbol", "loss_streak", "n_seen")


def q_trade_texts(spark, sf):
    """B13 + B18: money and clock texts and the sign of every closed trade's result."""
    prepare(spark)
    trades = FX.closed_trades(spark, sf)
    return trades.select("order_key", "line_number", "part_key", pl_sign("profit").alias("sign"),
                         money_text("profit").alias("profit_text"),
                         clock_text(F.col("closed_at") + F.make_dt_interval(secs=F.col("order_key") % 86_400)).alias("clock"))


#: Percent of the balance, dollars and percent of pullback that close all positions.
CLOSE_ALL = (10.0, 250.0, 20.0)


def q_peak_profit(spark, sf):
    """F9 + K5: running peak of the floating profit per account and symbol, reset on close-all."""
    prepare(spark)
    return rounded(ST.peak_profit(FX.equity_polls(spark, sf), *CLOSE_ALL))


def q_stream_peak_profit(spark, sf):
    """L4: the same as keyed state over four time slices that arrive one after the other."""
    prepare(spark)
    polls = FX.equity_polls(spark, sf)
    slices = _time_slices(polls, "ts")
    return rounded(ST.run_slices(spark, slices, lambda s: ST.keyed_peaks(s, *CLOSE_ALL), "peaks"))


def q_stream_indicators(spark, sf):
    """L1 → L2: closed M15 bars from the tick stream, then EMA/RSI as keyed state."""
    prepare(spark)
    slices = SS.bar_slices(_stream_bars_m15(spark, sf), 900)
    return rounded(ST.run_slices(spark, slices, ST.keyed_indicators, "indicators_m15"))


SIGNAL_COLS = ("macd_state", "ema_signal", "rsi_signal", "bb_signal", "bb_reason", "trend", "trend_reason", "sideways", "macd_zero", "combined", "trend_combined")


def q_stream_signals(spark, sf):
    """L1 → L2 → H1-H8, H13: closed M15 bars from the tick stream, indicators as keyed state, the rules on them."""
    prepare(spark)
    slices = SS.bar_slices(_stream_bars_m15(spark, sf), 900)
    return rounded(ST.run_slices(spark, slices, SS.keyed_signals, "signals_m15").select(*BAR_COLS, *SIGNAL_COLS))


def q_stream_technicals(spark, sf):
    """L1 → L2: ATR, ADX, MFI, Bollinger bands and MACD of closed M15 bars as keyed state."""
    prepare(spark)
    slices = SS.bar_slices(_stream_bars_m15(spark, sf), 900)
    out = ST.run_slices(spark, slices, SS.keyed_technicals, "technicals_m15")
    return rounded(out.select(*BAR_COLS, "atr", "adx", "mfi", "bb_upper", "bb_middle", "bb_lower", "macd", "macd_signal", "macd_hist"))


def q_asof_trend_h1_to_m15(spark, sf):
    """E6 + H5: each M15 bar with the EMA200 trend of the newest H1 bar closed by its close."""
    prepare(spark)
    m15 = B.events_bars(spark, sf, "M15")
    h1 = SG.trend_signals(_numbered(B.events_bars(spark, sf, "H1")))
    j = JN.asof_latest(
        m15.select("symbol", "tf", "time", "close"), h1.select("symbol", "time", "trend", "trend_reason"),
        left_time=F.col("time") + F.expr("INTERVAL 15 MINUTES"), right_time=F.col("time") + F.expr("INTERVAL 1 HOUR"),
        left_key=["symbol", "tf", "time"], right_cols=["time", "trend", "trend_reason"],
    )
    return rounded(j.select("symbol", "tf", "time", "close", F.col("r_time").alias("trend_time"),
                            F.coalesce("r_trend", F.lit("NEUTRAL")).alias("trend"),
                            F.coalesce("r_trend_reason", F.lit("")).alias("trend_reason")))


def q_strategy_decisions(spark, sf):
    """H14 + E7: rule strategy per bar (sideways → NEUTRAL, else the trend-gated combined
    signal) for the configured symbols only."""
    prepare(spark)
    bars = RK.restrict_symbols(B.lineitem_bars(spark, sf), RK.configured_symbols(spark, "A, R"))
    cfg = RK.StrategyConfig(use_ai=False, use_bb_ma_macd=False, use_trend_filter=True)
    decision = SG.choose_strategy(cfg.use_ai, cfg.use_bb_ma_macd, cfg.use_trend_filter)
    return SG.strategy_signals(_numbered(bars)).select(*BAR_COLS, decision.alias("decision"))


def _file_stream(spark, sf, table):
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return ST.file_stream(spark, sf, table, schema)


def _order_quotes(spark, sf):
    """Quotes from the orders table as a stream, a file a trigger."""
    return _file_stream(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("bid"),
        (F.col("o_totalprice") * F.lit(1.0002)).alias("ask"))


def q_stream_trailing_stops(spark, sf):
    """L6 + K3: stops that persist between polls, the best quotes so far as streaming state."""
    prepare(spark)
    polls = ST.run_to_table(spark, SP.best_quotes(_order_quotes(spark, sf)), "best_quotes", "update")
    info = FX.symbol_info(B.orders_bars(spark, sf))
    return rounded(SP.trailed_stops(FX.positions(spark, sf), polls, info, distance=300.0))


def q_stream_position_decisions(spark, sf):
    """Per micro-batch of order ticks, K3 trailing-stop decisions against the static
    position snapshot, written per batch id (a replayed batch overwrites its own output)."""
    import os

    from ..session import ensure_checkpoint_dir
    from ..sources import sinks

    prepare(spark)
    out = os.path.join(ensure_checkpoint_dir(spark), "streams", f"decisions-{os.urandom(8).hex()}")
    positions = FX.positions(spark, sf)
    info = FX.symbol_info(B.orders_bars(spark, sf))
    ticks = _order_quotes(spark, sf)

    def decide(batch, batch_id):
        quotes = B.latest_quote(batch)
        sinks.write_intents(RK.trailing_points(positions, quotes, info, distance=300.0), out, batch_id)

    ST.foreach_batch(ticks, decide, "position_decisions")
    return rounded(spark.read.parquet(out))


def q_stream_model_scores(spark, sf):
    """A saved V11 model scores the test-tail feature rows as they stream in."""
    import os

    from ..session import ensure_checkpoint_dir

    feats = _feature_rows(spark, sf, "v11", FE.V11_COLUMNS)
    split = BT.chronological_split(feats)
    model = ML.fit_ensemble(ML.balanced_weights(split.filter(F.col("t").isNull())), FE.V11_COLUMNS,
                            ML.EnsembleParams(rf_trees=10, gbt_iter=5))
    shared, run = ensure_checkpoint_dir(spark), os.urandom(8).hex()
    base = os.path.join(shared, "models", run)
    if model is not None:
        ML.save_bundle(model, base, "pooled")
    # the folder's own name: inputFiles() gives it URL-encoded, which no reader takes
    folder, out = os.path.join(shared, "tables", f"score_input-{run}"), os.path.join(shared, "streams", f"scores-{run}")
    split.filter(F.col("t").isNotNull()).drop("m").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)

    def score(batch, batch_id):
        bundle = ML.load_bundle(base, "pooled")
        if bundle is None:  # not trained: every row is a hold
            scored = batch.select(*BAR_COLS, "label", F.lit(0).alias("pred"), F.lit(0).alias("gated"))
        else:
            scored = bundle.predict(batch).select(*BAR_COLS, "label", "pred",
                                                  SG.confidence_gate(F.col("probs"), 0.54).alias("gated"))
        scored.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    ST.foreach_batch(stream, score, "model_scores")
    return spark.read.parquet(out).drop("batch")


def q_model_signal_veto(spark, sf):
    """H10 + H12: stand-in model class gated at 0.45, vetoed to 0 when volatility exceeds twice
    its 20-row mean on the feature rows (momentum set)."""
    feats = FE.build_features(_li(spark, sf), "momentum25").select(*BAR_COLS, "volatility")
    # incomplete rows are gone: frames count the rows that are left
    rows = number_rows(cut_lineage(feats, "feature_rows"), KEYS, "n")
    df = rolling(rows, lambda w: [("volatility_mean20", I.sma("volatility", 20, w))], back=19, idx="m")
    gated = SG.confidence_gate(SG.prob_array(), 0.45)
    df = FX.with_predictions(df)
    return rounded(df.select(*BAR_COLS, "volatility", "volatility_mean20", gated.alias("gated"),
                             SG.volatility_veto(gated).alias("signal")))


def q_bars_by_timeframe_code(spark, sf):
    """A2 + A3: event bars for several timeframe codes in one scan; an unknown code falls back to H1."""
    prepare(spark)
    ticks = B.events_ticks(spark, sf).select("symbol", "ts", F.col("bid").alias("price"))
    coded = ticks.withColumn("code", F.explode(F.array(*[F.lit(c) for c in ("M5", "M30", "H4", "X7")])))
    bars = B.bars_by_code(coded)
    return bars.groupBy("code", "bar_seconds", "symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("tick_volume").alias("n_ticks"))
