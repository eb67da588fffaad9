"""E1 against a plain search, with a dense right side, ties, gaps and missing keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candlewick.operators import joins as JN

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seed, dense", [(1, 5), (2, 400)])
def test_equals_plain_search(spark, seed, dense):
    r = random.Random(seed)

    def at(s):
        return START + timedelta(seconds=s)

    left = [(r.choice(["a", "b", "c", None]), at(r.randrange(9000)), i) for i in range(300)] + [("a", None, 300), ("a", at(900), 301), ("a", at(900), 301)]
    right = [(k, at(s), s * 1.5) for k in ("a", "b") for s in r.sample(range(9000), dense * 5)] + [(None, at(5), 0.0), ("a", None, 0.0)]
    ldf = spark.createDataFrame(left, "symbol string, time timestamp_ntz, id int").repartition(3)
    rdf = spark.createDataFrame(right, "symbol string, time timestamp_ntz, v double").repartition(3)
    got = JN.asof_backward(ldf, rdf, tolerance_seconds=60)
    assert got.columns == ["symbol", "time", "id", "r_time", "r_v"]
    expected = []
    for k, t, i in left:
        near = [x for x in right if t is not None and k is not None and x[0] == k and x[1] is not None and timedelta(0) <= t - x[1] <= timedelta(seconds=60)]
        m = max(near, key=lambda x: x[1], default=(None, None, None))
        expected.append((k, t, i, m[1], m[2]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_no_join_in_the_plan(spark):
    df = spark.range(10).select(F.lit("a").alias("symbol"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("time"), "id")
    plan = JN.asof_backward(df, df, tolerance_seconds=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
