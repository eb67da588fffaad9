"""No look-ahead: features on a truncated history equal features on the full history."""

import math

from pyspark.sql import functions as F

from candlewick.operators import features as FE
from candlewick.sources.bars import lineitem_bars
from conftest import SF_SMALL


def _rows(df, cols):
    return {(r.symbol, r.n): tuple(r[c] for c in cols) for r in df.collect()}


def _same(a, b):
    for x, y in zip(a, b):
        if x is None or y is None:
            assert x is None and y is None
        elif isinstance(x, float):
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert x == y


def test_prefix_invariance(spark):
    bars = lineitem_bars(spark, SF_SMALL)
    lo, hi = bars.agg(F.min("time"), F.max("time")).first()
    cut = lo + (hi - lo) * 0.7
    for fs in ("v11", "momentum25"):
        cols = FE.feature_columns(fs)
        full = _rows(FE.build_features(bars, fs, with_label=False), cols)
        part = _rows(FE.build_features(bars.filter(F.col("time") <= F.lit(cut)), fs, with_label=False), cols)
        assert part and set(part) <= set(full)
        for k, v in part.items():
            _same(v, full[k])
