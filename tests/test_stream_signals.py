"""Indicators and rules on a stream of closed bars, sliced in any way, against the batch operators."""

import json

import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators as I
from candlewick.operators import signals as SG
from candlewick.sources import bars as B
from candlewick.streaming import bars_stream as ST
from candlewick.streaming import signals_stream as SS
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def bars(spark):
    return B.lineitem_bars(spark, SF_SMALL).where("symbol <> 'N'")


def rows(df, cols):
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select("symbol", "n", *cols).collect())


def test_streamed_indicators_equal_batch(spark, bars):
    slices = SS.bar_slices(bars, 86400, most=900)
    assert len(slices) >= 3
    got = ST.run_slices(spark, slices, SS.keyed_technicals, "t")
    for build, cols in ((I.with_atr, ["atr"]), (I.with_adx, ["adx"]), (I.with_mfi, ["mfi"]), (I.with_bbands, ["bb_upper", "bb_middle", "bb_lower"]),
                        (I.with_macd, ["macd", "macd_signal", "macd_hist"]), (I.with_rsi, ["rsi_14"])):
        for a, b in zip(rows(got, cols), rows(build(I.numbered(bars)), cols), strict=True):
            assert a[:2] == b[:2] and all(x == y or x == pytest.approx(y, rel=1e-8, abs=1e-6) for x, y in zip(a[2:], b[2:]))


@pytest.mark.parametrize("most", [800, 4096])
def test_streamed_signals_equal_batch_for_any_slices(spark, bars, most):
    cols = ["macd_state", "ema_signal", "rsi_signal", "bb_signal", "trend", "trend_reason", "sideways", "macd_zero", "combined", "trend_combined"]
    got = ST.run_slices(spark, SS.bar_slices(bars.repartition(5), 86400, most), SS.keyed_signals, "s")
    assert rows(got, cols) == rows(SG.strategy_signals(I.numbered(bars)), cols)


def test_state_does_not_grow(spark):
    fold = SS.BarFold()
    sizes = []
    for i in range(2000):
        fold(10.0 + i % 7, 9.0 - i % 3, 9.5 + i % 5 / 10, 100.0)
        if i in (500, 1999):
            sizes.append(len(json.loads(fold.state)["closes"]) + len(json.loads(fold.state)["flows"]))
    assert sizes == [34, 34]
    # carried as text and read back, it goes on alike
    a, b = fold, SS.BarFold(fold.state)
    assert a(11.0, 8.0, 9.0, 5.0) == b(11.0, 8.0, 9.0, 5.0)


def test_flat_prices(spark):
    fold = SS.BarFold()
    out = [fold(5.0, 5.0, 5.0, 1.0) for _ in range(60)][-1]
    assert out["rsi_14"] == 0.0 and out["atr"] == 0.0 and out["adx"] == 0.0 and out["bb_upper"] == out["bb_lower"] == 5.0


def test_no_bars(spark, bars):
    assert len(SS.bar_slices(bars.where(F.lit(False)), 900)) == 1
