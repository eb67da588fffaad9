"""class distribution, confusion matrix and per-class metrics in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)


def _name(c: int) -> str:
    return {-1: "sell", 0: "hold", 1: "buy"}[c]


def classification_report(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts ``cm_<true>_<pred>``, accuracy, macro-F1 and per-class
    precision/recall/F1/support (0 where undefined, as ``zero_division=0``)."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n")]
    for a in CLASSES:
        for b in CLASSES:
            aggs.append(F.count_if((y == a) & (p == b)).alias(f"cm_{_name(a)}_{_name(b)}"))
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    cols = [F.col(c) for c in g.columns]
    f1s = []
    for c in CLASSES:
        tp = F.col(f"cm_{_name(c)}_{_name(c)}")
        support = sum((F.col(f"cm_{_name(c)}_{_name(b)}") for b in CLASSES), F.lit(0))
        predicted = sum((F.col(f"cm_{_name(a)}_{_name(c)}") for a in CLASSES), F.lit(0))
        prec = F.when(predicted > 0, tp / predicted).otherwise(F.lit(0.0))
        rec = F.when(support > 0, tp / support).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        f1s.append(f1)
        cols += [prec.alias(f"precision_{_name(c)}"), rec.alias(f"recall_{_name(c)}"),
                 f1.alias(f"f1_{_name(c)}"), support.alias(f"support_{_name(c)}")]
    correct = sum((F.col(f"cm_{_name(c)}_{_name(c)}") for c in CLASSES), F.lit(0))
    cols += [(correct / F.col("n")).alias("accuracy"), (sum(f1s, F.lit(0.0)) / F.lit(3.0)).alias("macro_f1")]
    return g.select(*cols)
