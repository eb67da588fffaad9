"""Backward as-of joins.

E1 (with a tolerance): both sides are stacked by key and time bucket as wide as the tolerance,
the newest right row of a bucket also in front of the next bucket, and a running ``last``
inside a bucket gives every left row its match. Linear in both sides, however dense the right
one is: one shuffle of the rows and one of a row per bucket, no join, no ordering of whole series.

E6 (without) stacks both sides, numbers them and takes a blocked running ``max``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .series import epoch_seconds


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str = "time",
    by: Sequence[str] = ("symbol",),
    tolerance_seconds: int,
    right_prefix: str = "r_",
) -> DataFrame:
    """Left rows with the newest right row at or before them within ``tolerance_seconds``
    (inclusive). Right columns come prefixed; unmatched rows get nulls."""
    width = F.lit(float(tolerance_seconds))
    rcols = [c for c in right.columns if c not in by]
    keys = [*by, "_bk"]

    def bucket(t: str) -> Column:
        return F.floor(F.col(t) / width).cast("long").alias("_bk")

    known = F.col(on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    r = right.where(known).select(*by, epoch_seconds(F.col(on)).alias("_t"), F.struct(*rcols).alias("_r")).select("*", bucket("_t"))
    # the newest right row of a bucket also stands before the rows of the next bucket
    carried = r.groupBy(*keys).agg(F.max_by("_r", "_t").alias("_r"), F.max("_t").alias("_t"))
    r = r.unionByName(carried.withColumn("_bk", F.col("_bk") + 1)).withColumn("_l", F.lit(None).cast(StructType(left.schema.fields)))
    rows = left.select(*by, epoch_seconds(F.col(on)).alias("_t"), F.struct(*left.columns).alias("_l")).select("*", bucket("_t"))
    rows = rows.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).unionByName(r)
    # at equal times the right row counts
    before = Window.partitionBy(*keys).orderBy("_t", F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("_l").isNull(), F.struct("_r", "_t")), ignorenulls=True).over(before)
    rows = rows.withColumn("_m", newest).where(F.col("_l").isNotNull())
    match = F.when(F.col("_t") - F.col("_m._t") <= width, F.col("_m._r"))
    rows = rows.select("_l", match.alias("_m"))
    return rows.select(*[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_m")[c].alias(right_prefix + c) for c in rcols])


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: Column,
    right_time: Column,
    by: Sequence[str] = ("symbol",),
    left_key: Sequence[str],
    right_cols: Sequence[str],
    right_prefix: str = "r_",
    chunk_seconds: int = 4096 * 3600,
) -> DataFrame:
    """Exact backward as-of without tolerance (newest right row at or before the left
    time; at equal times the right row counts).

    Both sides are stacked in time order per key, numbered with chunked counts, and a
    blocked running ``max`` of right-row positions gives every left row its match, which
    is then an equi-join on ``(key, position)``. No per-key sort of whole series, no
    inequality join, exact for any gap length.
    """
    from .series import number_bars, prefix_scan

    lk = list(left_key)
    l_side = left.select(*by, left_time.alias("_t"), F.lit(1).alias("_side"),
                         F.struct(*[F.col(c) for c in lk]).alias("_lk"),
                         F.lit(None).cast(right.select(F.struct(*[F.col(c) for c in right_cols])).schema[0].dataType).alias("_rp"))
    r_side = right.select(*by, right_time.alias("_t"), F.lit(0).alias("_side"),
                          F.lit(None).cast(l_side.schema["_lk"].dataType).alias("_lk"),
                          F.struct(*[F.col(c) for c in right_cols]).alias("_rp"))
    both = l_side.unionByName(r_side)
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    both = both.withColumn("_o", micros * F.lit(2) + F.col("_side").cast("long"))
    both = number_bars(both, by, order="_o", out="_pos",
                       chunk=F.floor(micros / F.lit(chunk_seconds * 1_000_000)))
    both = prefix_scan(both, [(F.when(F.col("_side") == 0, F.col("_pos")), "max", "_rpos")], keys=by, idx="_pos")
    matches = both.filter(F.col("_side") == 1).select(*by, "_lk", "_rpos")
    rights = both.filter(F.col("_side") == 0).select(*by, F.col("_pos").alias("_rpos"), "_rp")
    j = matches.join(rights, [*by, "_rpos"], "left")
    keyed = j.select(*[F.col("_lk")[c].alias(c) for c in lk],
                     *[F.col("_rp")[c].alias(right_prefix + c) for c in right_cols])
    return left.join(keyed, lk, "left")
