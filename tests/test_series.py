"""Blocked layouts agree with plain per-series windows at block edges."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.operators import indicators as I
from candlewick.operators import recurrence, series
from candlewick.operators.recurrence import Recurrence


def _series(spark, lengths):
    rows = []
    for s, n in lengths.items():
        for i in range(n):
            rows.append((s, "D1", i, float(100 + (i * 37 % 11) - (i % 5)), float(i % 3 + 1)))
    return spark.createDataFrame(rows, "symbol string, tf string, n long, close double, v double")


def test_halo_rolling_matches_window(spark):
    df = _series(spark, {"a": 129, "b": 65, "c": 1})
    got = series.rolling(
        df, lambda w: [("s", I.sma("close", 5, w)), ("ld", I.lead("close", 3, w))], back=4, fwd=3, block=8
    )
    w = Window.partitionBy("symbol", "tf").orderBy("n")
    exp = df.select(
        "symbol", "n",
        F.when(F.count("close").over(w.rowsBetween(-4, 0)) == 5, F.avg("close").over(w.rowsBetween(-4, 0))).alias("s"),
        F.lead("close", 3).over(w).alias("ld"),
    )
    a = {(r.symbol, r.n): (r.s, r.ld) for r in got.collect()}
    b = {(r.symbol, r.n): (r.s, r.ld) for r in exp.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12)


def test_prefix_scan_matches_running_window(spark):
    df = _series(spark, {"a": 70, "b": 17})
    got = series.prefix_scan(df, [("v", "sum", "cs"), ("v", "product", "cp"), ("close", "max", "cm")], block=8)
    rows = sorted(got.collect(), key=lambda r: (r.symbol, r.n))
    acc = {}
    for r in rows:
        s, p, m = acc.get(r.symbol, (0.0, 1.0, -1e18))
        s, p, m = s + r.v, p * r.v, max(m, r.close)
        acc[r.symbol] = (s, p, m)
        assert math.isclose(r.cs, s) and math.isclose(r.cp, p, rel_tol=1e-12) and r.cm == m


def test_number_bars_small_chunks(spark, monkeypatch):
    rows = [("x", "D1", f"2020-01-{d:02d} 00:00:00") for d in (1, 2, 5, 9, 10, 11, 30)]
    df = spark.createDataFrame(rows, "symbol string, tf string, t string").select(
        "symbol", "tf", F.to_timestamp("t").cast("timestamp_ntz").alias("time"))
    monkeypatch.setattr(series, "CHUNK_BARS", 2)
    got = [r.n for r in series.number_bars(df).orderBy("time").collect()]
    assert got == list(range(7))


def test_recurrence_carries_across_many_blocks(spark):
    n = 300
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.lit("D1").alias("tf"), F.col("id").alias("n"),
                               (F.col("id") % 7).cast("double").alias("x"))
    q = 0.9
    out = recurrence.run(df, [Recurrence("y", q, F.col("x"))]).orderBy("n").collect()
    y = 0.0
    for r in out:
        y = q * y + r.x
        assert math.isclose(r.y, y, rel_tol=1e-12)


def test_undefined_rows_keep_value(spark):
    df = spark.range(200).select(F.lit("s").alias("symbol"), F.lit("D1").alias("tf"), F.col("id").alias("n"))
    decay = (F.col("n") % 50) < 10
    out = recurrence.run(df, [Recurrence("y", 0.5, F.when(decay, F.lit(1.0)).otherwise(F.lit(0.0)), decay=decay)])
    y = 0.0
    for r in out.orderBy("n").collect():
        if r.n % 50 < 10:
            y = 0.5 * y + 1.0
        assert math.isclose(r.y, y, rel_tol=1e-12)


def test_composition_reaches_over_all_levels(spark, monkeypatch):
    """Small groups, so that all three levels and the steps between them are taken."""
    monkeypatch.setattr(recurrence, "FAN", 2)
    monkeypatch.setattr(recurrence, "BLOCK", 4)
    n = 230
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.lit("D1").alias("tf"), F.col("id").alias("n"))
    decay = (F.col("n") < 40) | (F.col("n") > 200)
    recs = [Recurrence("y", 0.9, (F.col("n") % 7).cast("double")), Recurrence("z", 0.5, F.when(decay, 1.0).otherwise(0.0), decay=decay)]
    y = z = 0.0
    for r in recurrence.run(df, recs).orderBy("n").collect():
        y = 0.9 * y + r.n % 7
        z = 0.5 * z + 1.0 if r.n < 40 or r.n > 200 else z
        assert math.isclose(r.y, y, rel_tol=1e-12) and math.isclose(r.z, z, rel_tol=1e-12)


def test_value_survives_a_long_run_without_decay(spark):
    n = 64 * 64 * 2 + 100
    df = spark.range(n).select(F.lit("s").alias("symbol"), F.lit("D1").alias("tf"), F.col("id").alias("n"))
    decay = F.col("n") < 100
    out = recurrence.run(df, [Recurrence("y", 0.9, F.when(decay, 1.0).otherwise(0.0), decay=decay)])
    last = out.where(F.col("n") == n - 1).first().y
    assert math.isclose(last, (1 - 0.9**100) / 0.1, rel_tol=1e-12)
