"""Halo layout with recurrences, packed tie-break keys, ML bundles and keyed stream state."""

import datetime
import math
import random
import tempfile

from pyspark.sql import functions as F

from candlewick.operators import indicators as I
from candlewick.operators import ml as ML
from candlewick.operators import risk as RK
from candlewick.operators import series
from candlewick.sources import bars as B
from candlewick.sources import fixtures as FX
from candlewick.streaming import bars_stream as ST
from conftest import SF_SMALL


def test_recurrences_inside_small_layout_blocks(spark, monkeypatch):
    n = 700
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.lit("D1").alias("tf"), F.col("id").alias("n"),
                               (100.0 + (F.col("id") * 37 % 11) - (F.col("id") % 5)).alias("close"))
    plain = I.with_ema(df, 12).select("n", "ema_12")
    sf = series.SeriesFrame(df, back=64 + 2 * 64, block=256)
    sf.recur([I.ema_rec("e", "close", 12)])
    sf.columns({"e": I.valid_from(F.col("e"), 11)})
    sf.windows(lambda w: [("d", F.col("e") - F.lag("e", 1).over(w))])
    got = {r.n: (r.e, r.d) for r in sf.result().collect()}
    exp = {r.n: r.ema_12 for r in plain.collect()}
    assert len(got) == n
    for k in range(n):
        e, d = got[k]
        assert (e is None and exp[k] is None) or math.isclose(e, exp[k], rel_tol=1e-12)
        if k >= 12:
            assert math.isclose(d, exp[k] - exp[k - 1], rel_tol=1e-9, abs_tol=1e-9)


def test_order_key_breaks_ties_in_order(spark):
    rows = [("a", f"2020-01-01 0{h}:00:00", k, ln, p, float(k * 10 + ln)) for h in range(3)
            for k, ln, p in [(5, 2, 9), (5, 1, 7), (3, 4, 1), (3, 4, 0)]]
    ticks = spark.createDataFrame(rows, "symbol string, t string, k long, ln int, p long, price double").select(
        "symbol", F.to_timestamp("t").alias("ts"), "k", "ln", "p", "price")
    packed = B.ticks_to_bars(ticks, "D1", order=["k", "ln", "p"]).first()
    struct_order = ticks.groupBy("symbol").agg(
        F.min_by("price", F.struct("k", "ln", "p")).alias("o"), F.max_by("price", F.struct("k", "ln", "p")).alias("c")).first()
    assert (packed.open, packed.close) == (struct_order.o, struct_order.c)


def test_bundle_round_trip_and_predict(spark):
    feats = FX.with_predictions(I.numbered(B.lineitem_bars(spark, SF_SMALL))).withColumn(
        "label", F.when(F.col("p_buy") > F.col("p_sell"), 1).when(F.col("p_sell") > F.col("p_buy"), -1).otherwise(0))
    cols = ["p_sell", "p_hold", "p_buy"]
    model = ML.fit_ensemble(ML.balanced_weights(feats), cols, ML.EnsembleParams(rf_trees=5, gbt_iter=3))
    assert model is not None
    base = tempfile.mkdtemp(prefix="bundle-", dir="/tmp")
    ML.save_bundle(model, base, "A")
    again = ML.load_bundle(base, "A")
    assert again.features == cols
    a = [r.pred for r in model.predict(feats).orderBy("symbol", "n").collect()]
    b = [r.pred for r in again.predict(feats).orderBy("symbol", "n").collect()]
    assert a == b and set(a) <= {-1, 0, 1}
    assert ML.load_bundle(base, "missing") is None
    imp = ML.feature_importances(model)
    assert [c for c, _ in imp] and imp[0][1] >= imp[-1][1]
    assert math.isclose(sum(w for _, w in imp), 1.0, rel_tol=1e-9)
    # H9: the fitted model's class leads to signals and metrics
    scored = model.predict(feats)
    right = scored.filter(F.col("pred") == F.col("label")).count() / scored.count()
    assert right > 0.9
    assert {r[0] for r in scored.select(F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), 6)).distinct().collect()} == {1.0}


def test_soft_vote_normalises_one_vs_rest(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.5], 0.1, 0.3, 0.6), ([1.0, 0.0, 0.0], 0.0, 0.0, 0.0)], "f array<double>, a double, b double, c double")
    got = [r[0] for r in df.select(ML.soft_vote(F.col("f"), [F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert all(math.isclose(x, y) for x, y in zip(got[0], (0.15, 0.3, 0.55)))
    assert all(math.isclose(x, y) for x, y in zip(got[1], (2 / 3, 1 / 6, 1 / 6)))


def test_models_per_symbol_and_guard(spark):
    feats = FX.with_predictions(I.numbered(B.lineitem_bars(spark, SF_SMALL))).withColumn("label", (F.col("n") % 3).cast("int") - 1)
    few = feats.filter((F.col("symbol") != "R") | (F.col("n") < 50))
    models = ML.fit_per_symbol(few, ["p_sell", "p_buy"], ["A", "R", "Z"], ML.EnsembleParams(rf_trees=2, gbt_iter=1))
    assert models["A"] is not None and models["R"] is None and models["Z"] is None


def test_streams_read_files_and_folders_alike(spark, tmp_path):
    for t in ("events", "orders", "lineitem", "customer"):
        table = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        if t != "events":
            table.repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
            continue
        # a stream's files arrive in time order: later rows than the watermark allows are dropped
        times = [r.ts for r in table.select("ts").orderBy("ts").collect()]
        low, high = times[len(times) // 3], times[2 * len(times) // 3]
        for part in (F.col("ts") <= low, (F.col("ts") > low) & (F.col("ts") <= high), F.col("ts") > high):
            table.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{t}.parquet")
    from candlewick.plans import catalog

    for q in (catalog.q_stream_bars_m15, catalog.q_stream_indicators):
        assert sorted(map(str, q(spark, str(tmp_path)).collect())) == sorted(map(str, q(spark, SF_SMALL).collect()))
    rows = catalog.q_stream_position_decisions(spark, str(tmp_path)).groupBy("batch_id").count().collect()
    assert len(rows) == 3 and len({r["count"] for r in rows}) == 1


def test_tick_bars_do_not_depend_on_file_layout(spark, tmp_path):
    from candlewick.plans import catalog

    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")  # every file spans the whole time
    for q in (catalog.q_stream_bars_m15, catalog.q_stream_indicators):
        assert sorted(map(str, q(spark, str(tmp_path)).collect())) == sorted(map(str, q(spark, SF_SMALL).collect()))
    newest = events.agg(F.max("ts")).first()[0]
    closed = F.window("ts", "900 seconds")["end"] <= F.lit(newest) - F.expr("INTERVAL 1 HOUR")
    bars = catalog.q_stream_bars_m15(spark, str(tmp_path))
    assert bars.agg(F.sum("tick_volume")).first()[0] == events.filter(closed).count()


def test_keyed_state_over_slices_equals_batch(spark):
    trades = FX.closed_trades(spark, SF_SMALL)
    day = F.col("closed_at")
    cuts = [r[0] for r in trades.select("closed_at").orderBy("closed_at").collect()][::2000][1:]
    bounds = [None, *cuts, None]
    slices = [trades.filter((F.lit(True) if lo is None else day > lo) & (F.lit(True) if hi is None else day <= hi))
              for lo, hi in zip(bounds, bounds[1:])]
    assert len(slices) >= 3
    out = ST.run_slices(spark, slices, ST.keyed_trade_state, "trade_state").collect()
    newest = {}
    for r in sorted(out, key=lambda r: r.n_seen):
        newest[r.symbol] = (r.loss_streak, r.n_seen)
    assert newest == {r.symbol: (r.loss_streak, r.n_closed) for r in RK.loss_streaks(trades).collect()}


def test_many_keys_share_a_state_group(spark, monkeypatch):
    monkeypatch.setattr(ST, "KEY_GROUPS", 3)
    r = random.Random(5)
    at = [(r.randrange(12), r.choice("ab"), i) for i in range(400)]
    polls = [(a, s, i, datetime.datetime(2024, 1, 1, 0, i // 10), float(r.randrange(-50, 60)), 1000.0) for a, s, i in at]
    table = spark.createDataFrame(polls, "account_id long, symbol string, poll long, ts timestamp_ntz, floating_profit double, balance double")
    slices = [table.where(F.col("poll").between(*b)) for b in ((0, 99), (100, 259), (260, 399))]
    rules = (10.0, 55.0, 20.0)
    streamed = ST.run_slices(spark, slices, lambda s: ST.keyed_peaks(s, *rules), "peaks")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, ST.peak_profit(table, *rules).collect()))
    trades = table.select(F.concat("symbol", F.col("account_id").cast("string")).alias("symbol"), F.col("ts").alias("closed_at"), F.col("poll").alias("order_key"),
                          F.lit(1).alias("line_number"), F.lit(None).cast("long").alias("part_key"), F.col("floating_profit").alias("profit"))
    slices = [trades.where(F.col("order_key").between(*b)) for b in ((0, 99), (100, 259), (260, 399))]
    plain, seen, shown = {}, {}, []
    for a, s, i, _, profit, _ in polls:
        key = f"{s}{a}"
        plain[key], seen[key] = 0 if profit >= 0 else plain.get(key, 0) + 1, seen.get(key, 0) + 1
        shown.append((i, key, plain[key], seen[key]))
    ends = {(next(x for x in reversed(shown) if x[1] == k and lo <= x[0] <= hi)[1:]) for lo, hi in ((0, 99), (100, 259), (260, 399)) for k in {x[1] for x in shown if lo <= x[0] <= hi}}
    assert {tuple(x) for x in ST.run_slices(spark, slices, ST.keyed_trade_state, "trades").collect()} == ends


def test_random_search_expanding_folds(spark):
    feats = FX.with_predictions(I.numbered(B.lineitem_bars(spark, SF_SMALL))).withColumn(
        "label", F.when(F.col("p_buy") > F.col("p_sell"), 1).when(F.col("p_sell") > F.col("p_buy"), -1).otherwise(0))
    grid = {"rf_trees": [3, 5], "rf_depth": [3], "gbt_iter": [2], "gbt_depth": [2]}
    best, scores, model = ML.random_search(feats, ["p_sell", "p_hold", "p_buy"], grid, draws=2, n_folds=2)
    assert model.rf.getNumTrees == best["rf_trees"]
    assert set(best) == set(grid) and len(scores) == 2
    assert all(0.0 <= s <= 1.0 for _, s in scores)


def test_configured_symbols_and_filters(spark):
    syms = sorted(r.symbol for r in RK.configured_symbols(spark, " A, R ,, A").collect())
    assert syms == ["A", "R"]
    pos = FX.positions(spark, SF_SMALL)
    one = RK.positions_for(pos, magic=1).collect()
    assert one and all(r.magic == 1 for r in one)
