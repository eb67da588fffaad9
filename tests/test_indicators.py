"""Indicators against a sequential loop, on driver bars and hand-made edge series."""

import math

import pytest
from pyspark.sql import functions as F

import seq_oracle as O
from candlewick.operators import indicators as I
from candlewick.operators.series import number_bars, rolling
from candlewick.sources.bars import lineitem_bars
from conftest import SF_SMALL


def _check(rows, col, expected):
    for r, e in zip(rows, expected):
        assert O.close(getattr(r, col), e, 1e-9, 1e-9), (col, r.n, getattr(r, col), e)


@pytest.fixture(scope="module")
def li(spark):
    return I.numbered(lineitem_bars(spark, SF_SMALL)).cache()


def test_against_sequential_loop(li):
    def series(df):
        by = {}
        for r in df.orderBy("symbol", "n").collect():
            by.setdefault(r.symbol, []).append(r)
        assert len(by) == 3
        return by.values()

    def ohlc(rs, *names):
        return [[getattr(r, n) for r in rs] for n in names]

    for rs in series(I.with_ema(li, 12)):
        _check(rs, "ema_12", O.ema(*ohlc(rs, "close"), 12))
    for rs in series(I.with_rsi(li)):
        _check(rs, "rsi_14", O.rsi(*ohlc(rs, "close")))
    for rs in series(I.with_atr(li)):
        _check(rs, "atr", O.atr(*ohlc(rs, "high", "low", "close")))
    for rs in series(I.with_adx(li)):
        _check(rs, "adx", O.adx(*ohlc(rs, "high", "low", "close")))
    for rs in series(I.with_macd(li)):
        m, s, _ = O.macd(*ohlc(rs, "close"))
        _check(rs, "macd", m)
        _check(rs, "macd_signal", s)


@pytest.mark.parametrize("length", [1, 13, 14, 15, 33, 34, 63, 64, 65, 129])
def test_edge_lengths(spark, length):
    rows = [("e", "D1", i, 10.0 + (i % 4), 11.0 + (i % 4), 9.0 + (i % 3), 10.0 + (i % 5) * 0.5)
            for i in range(length)]
    df = spark.createDataFrame(rows, "symbol string, tf string, n long, open double, high double, low double, close double")
    c = [r[6] for r in rows]
    h = [r[4] for r in rows]
    lo = [r[5] for r in rows]
    _check(I.with_rsi(df).orderBy("n").collect(), "rsi_14", O.rsi(c))
    _check(I.with_adx(df).orderBy("n").collect(), "adx", O.adx(h, lo, c))
    _check(I.with_macd(df).orderBy("n").collect(), "macd", O.macd(c)[0])


def test_flat_and_ramp(spark):
    flat = [("f", "D1", i, 5.0, 5.0, 5.0, 5.0) for i in range(60)]
    ramp = [("r", "D1", i, 1.0 + i, 1.5 + i, 0.5 + i, 1.0 + i) for i in range(60)]
    df = spark.createDataFrame(flat + ramp, "symbol string, tf string, n long, open double, high double, low double, close double")
    out = I.with_bbands(I.with_adx(I.with_rsi(df))).collect()
    for r in out:
        if r.n >= 14:
            assert r.rsi_14 == (0.0 if r.symbol == "f" else 100.0)
        if r.symbol == "f" and r.n >= 19:
            assert r.bb_upper == r.bb_lower == 5.0
        if r.symbol == "f" and r.n >= 27:
            assert r.adx == 0.0
        if r.n < 13:
            assert r.rsi_14 is None


def test_macd_first_values(spark):
    rows = [("m", "D1", i, 1.0, 1.0, 1.0, 100.0 + (i * 7 % 13)) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, tf string, n long, open double, high double, low double, close double")
    a = I.with_macd(df).orderBy("n").collect()
    b = I.with_macd(df, 11, 27, 4, prefix="m4").orderBy("n").collect()
    assert a[32].macd is None and a[33].macd is not None
    assert b[28].m4 is None and b[29].m4 is not None


def test_two_symbols_isolated(spark, li):
    both = I.with_rsi(li).filter(F.col("symbol").isin("A", "N"))
    one = I.with_rsi(li.filter(F.col("symbol") == "A"))
    a = {r.n: r.rsi_14 for r in both.filter(F.col("symbol") == "A").collect()}
    b = {r.n: r.rsi_14 for r in one.collect()}
    assert a == b


def test_long_sma_matches_sma_with_gaps_and_at_block_edges(spark):
    rows = [("a", "M1", i, None if i == 37 else 100.0 + (i * 37 % 11) * 0.25) for i in range(150)]
    rows += [("b", "M1", i, float(i)) for i in range(19)]
    df = spark.createDataFrame(rows, "symbol string, tf string, n long, close double")
    got = rolling(df, lambda w: I.long_sma("long", "close", 20, w, step=5) + [("plain", I.sma("close", 20, w))], back=19, block=32)
    out = got.collect()
    assert len(out) == len(rows) and sum(r.plain is not None for r in out) == 150 - 19 - 20
    for r in out:
        assert (r.long is None) == (r.plain is None)
        assert r.long is None or math.isclose(r.long, r.plain, rel_tol=1e-13)


def test_chained_passes_read_their_rows_from_tables(spark):
    df = I.with_adx(I.with_atr(number_bars(lineitem_bars(spark, SF_SMALL))))
    # the last pass reads the ends of its blocks and its bars; nothing before it is computed again
    scans = [f.rsplit("/", 2)[-2] for f in df.inputFiles()]
    assert scans and all(f.startswith("dx-") for f in scans)
