"""Output conventions of registered queries: rounded doubles, naive timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def round_col(x, digits: int = DIGITS):
    """``floor(x * 10^d + 0.5) / 10^d`` below 1e6 in magnitude, else ``digits`` significant
    digits: plain IEEE steps, so any engine gets the same bits."""
    scale = float(10**digits)
    v = x.cast("double")
    small = F.floor(v * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))).cast("double") - F.lit(float(digits - 1)))
    expo = (F.floor(F.log10(F.abs(v))) - F.lit(digits - 1)).cast("long")
    mant = F.floor(v / unit + F.lit(0.5)).cast("long")
    big = F.concat(mant.cast("string"), F.lit("e"), expo.cast("string")).cast("double")
    return F.when(F.abs(v) < F.lit(1e6), small).when(F.isnan(v), v).when(F.abs(v) == F.lit(float("inf")), v).otherwise(big)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (``+ 0.0`` folds a negative zero into zero)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_col(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
