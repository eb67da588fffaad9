"""Blocked first-order linear recurrence: ``y[n] = q**d[n] * y[n-1] + u[n]``.

No SQL window frame expresses a recurrence, so it is evaluated as a two-level scan made
of ordinary window functions, grouped by ``(key, block)`` and never by the key alone:

1. Rows are cut into blocks of ``B`` bars. Inside a block, with ``D`` the running count
   of decaying rows (``d`` = 1), ``loc = q**D * sum(u * q**-D)`` is a running sum.
2. A block maps the value before it to the value at its end: ``Y -> Y * q**M + e``, with
   ``M`` its decay count and ``e`` its own end value. These maps are composed exactly, over
   all earlier blocks, in three levels: inside groups of ``FAN`` blocks, inside groups of
   ``FAN`` such groups, and over all totals of those before (one per ``B * FAN * FAN`` bars).
   Nothing is truncated, so a run of rows that never decays keeps its value for ever.
3. ``y = loc + Y[b-1] * q**D`` after an equi-join on ``(key, block)``.

Rows with ``d`` = 0 carry the value unchanged (``q**0``): TA-style seeds are written as
a non-decaying warm-up that accumulates ``x/p`` and the undefined-DX rows of ADX keep
their value.

All recurrences of one dependency level are packed into one call: one block window,
one end-of-block table and one join for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import KEYS

BLOCK = 64
FAN = 64


@dataclass(frozen=True)
class Recurrence:
    name: str
    q: float
    u: Column
    decay: Column | None = None


def _block_size(recs: Sequence[Recurrence]) -> int:
    worst = max(abs(math.log(r.q)) for r in recs)
    return max(1, min(BLOCK, int(600.0 / worst) if worst > 0 else BLOCK))


def _folded(maps: str, r: Recurrence) -> Column:
    """Value after a list of maps, starting from 0."""

    def step(acc: Column, m: Column) -> Column:
        return acc * F.pow(F.lit(r.q), m[f"_M_{r.name}"].cast("double")) + m[f"_e_{r.name}"]

    return F.aggregate(maps, F.lit(0.0), step)


def block_values(ends: DataFrame, recs: Sequence[Recurrence], keys: Sequence[str]) -> DataFrame:
    """``keys``, ``_b`` and ``_Y_*``: the value before each block, from all earlier blocks' maps.

    ``ends`` is read once: a row per ``FAN`` blocks carries their maps as an array, so the
    levels need no joins. Only these rows, one per ``B * FAN`` bars, meet by series.
    """
    names = [r.name for r in recs]
    maps = [F.col(f"_{c}_{n}") for n in names for c in ("e", "M")]
    groups = ends.groupBy(*keys, F.floor(F.col("_b") / F.lit(FAN)).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_b", *maps))).alias("_in"))
    groups = groups.repartition(*[F.col(k) for k in keys]).withColumn("_g", F.floor(F.col("_s") / F.lit(FAN)))
    # the group as one map
    groups = groups.withColumns({f"_e_{r.name}": _folded("_in", r) for r in recs} | {f"_M_{r.name}": _decays("_in", r) for r in recs})
    one = F.struct(*maps)
    before = Window.partitionBy(*keys, "_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_some", F.collect_list(one).over(before))
    # all maps of a group of groups as one, at its last row
    last = F.col("_s") % F.lit(FAN) == FAN - 1
    whole = F.struct(*[x for r in recs for x in (
        (_folded("_some", r) * F.pow(F.lit(r.q), F.col(f"_M_{r.name}").cast("double")) + F.col(f"_e_{r.name}")).alias(f"_e_{r.name}"),
        (_decays("_some", r) + F.col(f"_M_{r.name}")).alias(f"_M_{r.name}"))])
    earlier = Window.partitionBy(*keys).orderBy("_g").rangeBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_all", F.concat(F.collect_list(F.when(last, whole)).over(earlier), "_some"))
    groups = groups.select(*keys, "_in", *[_after_each("_in", r, _folded("_all", r)).alias(f"_y_{r.name}") for r in recs])
    out = groups.select(*keys, F.explode(F.arrays_zip(F.transform("_in", lambda m: m["_b"] + 1).alias("_b"), *[f"_y_{n}" for n in names])).alias("_at"))
    return out.select(*keys, F.col("_at._b").alias("_b"), *[F.col("_at")[f"_y_{n}"].alias(f"_Y_{n}") for n in names])


def _decays(maps: str, r: Recurrence) -> Column:
    return F.aggregate(maps, F.lit(0).cast("long"), lambda acc, m: acc + m[f"_M_{r.name}"])


def _after_each(maps: str, r: Recurrence, start: Column) -> Column:
    """Value after each of a list of maps."""

    def step(acc: Column, m: Column) -> Column:
        return F.concat(acc, F.array(F.element_at(acc, -1) * F.pow(F.lit(r.q), m[f"_M_{r.name}"].cast("double")) + m[f"_e_{r.name}"]))

    return F.aggregate(maps, F.array(start), step, lambda acc: F.slice(acc, F.lit(2), F.size(acc)))


def run(
    df: DataFrame,
    recs: Sequence[Recurrence],
    *,
    keys: Sequence[str] = KEYS,
    idx: str = "n",
    within: str | None = None,
    within_span: int | None = None,
) -> DataFrame:
    """Add one column per recurrence (named ``rec.name``) to ``df``.

    ``within`` names the block column of a ``series.SeriesFrame`` layout (rows already
    hash-partitioned by ``keys + within``, halo copies flagged ``_halo``): the block
    windows then nest inside that partitioning and the carry join keeps it, so the bar
    rows are not shuffled again. ``within_span`` is the layout block size in rows.
    """
    for r in recs:
        if not 0.0 < r.q < 1.0:
            raise ValueError(f"{r.name}: q must be in (0, 1)")
    B = _block_size(recs)
    if within is not None and B != BLOCK:
        raise ValueError("recurrences inside a layout need q >= exp(-600/64)")
    part = [*keys, within] if within else list(keys)
    base = df.withColumn("_b", F.floor(F.col(idx) / F.lit(B)).cast("long"))
    base = base.withColumn("_k", (F.col(idx) - F.col("_b") * F.lit(B)).cast("int"))
    w = Window.partitionBy(*part, "_b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)

    base = base.withColumns({
        f"_D_{r.name}": (F.col("_k") + 1) if r.decay is None else F.sum(F.when(r.decay, 1).otherwise(0)).over(w)
        for r in recs
    })
    loc = {}
    for r in recs:
        D = F.col(f"_D_{r.name}").cast("double")
        term = F.coalesce(r.u, F.lit(0.0)) * F.pow(F.lit(r.q), -D)
        loc[f"_L_{r.name}"] = F.pow(F.lit(r.q), D) * F.sum(term).over(w)
    base = base.withColumns(loc)

    at_end = F.col("_k") == F.lit(B - 1)
    if within:
        at_end = at_end & ~F.col("_halo")
    ends = base.filter(at_end).select(
        *keys,
        "_b",
        *[F.col(f"_L_{r.name}").alias(f"_e_{r.name}") for r in recs],
        *[F.col(f"_D_{r.name}").cast("long").alias(f"_M_{r.name}") for r in recs],
    )
    carry = block_values(ends, recs, keys)
    if within:
        # a block's rows live in its own layout block and as halo copies in the neighbours
        per = (within_span or B) // B
        home = F.floor(F.col("_b") / F.lit(per)).cast("long")
        carry = carry.withColumn(within, F.explode(F.array(home - 1, home, home + 1)))
    out = base.join(carry, [*part, "_b"], "left")
    out = out.withColumns({
        r.name: F.col(f"_L_{r.name}")
        + F.coalesce(F.col(f"_Y_{r.name}"), F.lit(0.0)) * F.pow(F.lit(r.q), F.col(f"_D_{r.name}").cast("double"))
        for r in recs
    })
    drop = ["_b", "_k"]
    for r in recs:
        drop += [f"_D_{r.name}", f"_L_{r.name}", f"_Y_{r.name}"]
    return out.drop(*drop)
