"""Trailing stops as streaming state against K3 applied quote after quote."""

import math

from pyspark.sql import functions as F

from candlewick.plans import catalog
from candlewick.streaming import bars_stream as ST
from candlewick.streaming import stops_stream as SP
from conftest import SF_SMALL

DISTANCE, POINT, DIGITS = 30.0, 0.01, 2
POSITIONS = [(1, t, s, side, price, sl, 0.0) for t, (s, side, price, sl) in enumerate([
    ("a", "BUY", 100.0, 0.0), ("a", "BUY", 100.0, 100.4), ("a", "SELL", 101.0, 0.0), ("a", "SELL", 101.0, 100.2), ("a", "BUY", 500.0, 0.0),
    ("b", "SELL", 7.0, 7.5), ("b", "BUY", 6.0, 5.0), ("none", "BUY", 1.0, 0.5), ("none", "SELL", 1.0, 0.0), ("nan", "BUY", 1.0, 0.0)])]


def quotes():
    out = []
    for i in range(240):
        mid = 100.5 + math.sin(i * 0.37) * (0.2 + i / 300) + (i * 37 % 11) / 1000
        out.append(("a", i, mid, mid + 0.013))
        out.append(("b", i, mid / 15, mid / 15 + 0.004 if i % 5 else None))
    return [*out, ("nan", 0, math.nan, math.nan), ("nan", 1, None, None)]


def fold(rows):
    """Each quote in time order against the stops that earlier ones left."""
    stops, moved = {p[1]: p[5] for p in POSITIONS}, set()
    for symbol, _, bid, ask in sorted(rows, key=lambda r: r[1]):
        for _, ticket, of, side, opened, _, _ in POSITIONS:
            price = bid if side == "BUY" else ask
            if of != symbol or price is None or math.isnan(price):
                continue
            gain = price - opened if side == "BUY" else opened - price
            new = price - DISTANCE * POINT if side == "BUY" else price + DISTANCE * POINT
            tighter = stops[ticket] == 0 or (new > stops[ticket] if side == "BUY" else new < stops[ticket])
            if math.trunc(round(gain / POINT, 6)) >= DISTANCE and tighter:
                stops[ticket] = round(new, DIGITS)
                moved.add(ticket)
    return {t: (s or None, t in moved) for t, s in stops.items()}


def test_stops_persist_between_polls(spark, tmp_path):
    ticks = spark.createDataFrame(quotes(), "symbol string, seq long, bid double, ask double")
    positions = spark.createDataFrame(POSITIONS, "account_id long, ticket long, symbol string, type string, price_open double, sl double, tp double")
    info = spark.createDataFrame([(s, POINT, DIGITS) for s in ("a", "b", "nan")], "symbol string, point double, digits int")
    cuts = [(0, 40), (40, 160), (160, 240)]
    for lo, hi in cuts:
        ticks.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    polls = ST.run_to_table(spark, SP.best_quotes(stream), "test_best_quotes", "update")
    assert polls.select("batch").distinct().count() == 3
    for k, (_, hi) in enumerate(cuts):
        got = {r.ticket: (r.stop, r.move_sl) for r in SP.trailed_stops(positions, polls.filter(F.col("batch") <= k), info, DISTANCE).collect()}
        assert got == fold([q for q in quotes() if q[1] < hi]), k
    assert len({s for s, _ in got.values()}) > 4 and got[7] == (0.5, False) and got[9] == (None, False)


def test_no_quotes_and_no_positions(spark):
    positions = spark.createDataFrame(POSITIONS, "account_id long, ticket long, symbol string, type string, price_open double, sl double, tp double")
    info = spark.createDataFrame([("a", POINT, DIGITS)], "symbol string, point double, digits int")
    none = spark.createDataFrame([], "symbol string, bid double, ask double")
    assert {r.ticket: r.stop for r in SP.trailed_stops(positions, none, info, DISTANCE).collect()} == {p[1]: p[5] or None for p in POSITIONS}
    assert SP.trailed_stops(positions.limit(0), none, info, DISTANCE).count() == 0


def test_stops_do_not_depend_on_files(spark, tmp_path):
    for t in ("orders", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    one, three = (sorted(map(str, catalog.q_stream_trailing_stops(spark, str(d)).collect())) for d in (SF_SMALL, tmp_path))
    assert one == three and len(one) > 100
