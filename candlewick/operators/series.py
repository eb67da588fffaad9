"""Ordered-series layout shared by every per-instrument operator.

A series is the set of bars of one key (by default ``symbol, tf``) ordered by ``time``.
Nothing here partitions by the key alone, so one instrument holding a third of all bars
still spreads over many tasks:

* ``number_bars`` gives each bar its dense 0-based position ``n``. Bars fall into time
  chunks of a fixed number of bar slots; chunk sizes are counted with a partial
  aggregate, prefix-summed on the (small) chunk table, and joined back.
* ``halo_layout`` cuts a numbered series into blocks of ``block`` bars and copies the
  last ``back`` (first ``fwd``) bars of each block into the next (previous) block, so a
  fixed-row window frame sees its neighbours while partitioned by ``(key, block)``.
* ``rolling`` runs window expressions over that layout and drops the copies again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS: tuple[str, ...] = ("symbol", "tf")

# Bar size in seconds of each timeframe code; an unknown code means H1.
TIMEFRAME_SECONDS = {
    "M1": 60,
    "M5": 300,
    "M15": 900,
    "M30": 1800,
    "H1": 3600,
    "H4": 14400,
    "D1": 86400,
}
DEFAULT_TIMEFRAME = "H1"

# Bars per numbering chunk and per rolling block. Halo copies cost back/ROLL_BLOCK.
CHUNK_BARS = 4096
ROLL_BLOCK = 4096


def timeframe_seconds(code: str) -> int:
    """A2: timeframe code to bar size; unknown codes fall back to H1."""
    return TIMEFRAME_SECONDS.get(code, TIMEFRAME_SECONDS[DEFAULT_TIMEFRAME])


def timeframe_seconds_col(code: Column) -> Column:
    """A2 as a column expression (a literal map lookup, H1 when absent)."""
    pairs = []
    for k, v in TIMEFRAME_SECONDS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(
        F.element_at(F.create_map(*pairs), code),
        F.lit(TIMEFRAME_SECONDS[DEFAULT_TIMEFRAME]),
    ).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since epoch of a timestamp or timestamp_ntz column (UTC session)."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(1_000_000.0)


def number_bars(
    bars: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "time",
    out: str = "n",
    chunk: Column | None = None,
    total: str | None = None,
) -> DataFrame:
    """Dense 0-based bar number per key (and ``total``: its number of bars), without a per-key partition.

    ``chunk`` groups bars into ordered chunks that each hold a bounded number of bars;
    by default ``CHUNK_BARS`` bar slots of the row's timeframe (bars are unique per slot).
    """
    if chunk is None:
        width = timeframe_seconds_col(F.col("tf")) * F.lit(CHUNK_BARS)
        chunk = F.floor(epoch_seconds(F.col(order)) / width)
    df = bars.withColumn("_chunk", chunk.cast("long"))
    sizes = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"),
        *([F.sum("_cnt").over(every).alias(total)] if total else []),
    )
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order)
    # places are counted before the join: sorted for the window, rows are sorted for the join too
    return (
        df.withColumn("_place", F.row_number().over(inner))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_off") + F.col("_place") - 1).cast("long"))
        .drop("_chunk", "_off", "_place")
    )


def halo_layout(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    block: int,
    back: int = 0,
    fwd: int = 0,
) -> DataFrame:
    """Assign ``_blk`` and copy boundary rows into neighbour blocks (``_halo`` = copy)."""
    if back > block or fwd > block:
        raise ValueError("halo wider than block")
    b = F.floor(F.col(idx) / F.lit(block)).cast("long")
    k = F.col(idx) - b * F.lit(block)
    entries = [F.struct(b.alias("_blk"), F.lit(False).alias("_halo"))]
    if back > 0:
        entries.append(
            F.when(k >= F.lit(block - back), F.struct((b + 1).alias("_blk"), F.lit(True).alias("_halo")))
        )
    if fwd > 0:
        entries.append(
            F.when((k < F.lit(fwd)) & (b > 0), F.struct((b - 1).alias("_blk"), F.lit(True).alias("_halo")))
        )
    if len(entries) == 1:
        return df.withColumn("_blk", b).withColumn("_halo", F.lit(False))
    placed = F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return df.withColumn("_lay", placed).select(
        *[F.col(c) for c in df.columns], F.col("_lay._blk").alias("_blk"), F.col("_lay._halo").alias("_halo")
    )


WindowBuilder = Callable[[Window], Iterable[tuple[str, Column]]]


def add_columns(df: DataFrame, pairs: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add columns in as few ``withColumns`` steps as their dependencies allow.

    A column that mentions a name added in the pending batch starts a new batch, so
    independent window expressions over one spec land in one Window operator and the
    plan is analysed once per batch instead of once per column.
    """
    import re

    batch: dict[str, Column] = {}
    for name, column in pairs:
        text = str(column)
        if any(re.search(rf"(?<![A-Za-z0-9_]){re.escape(b)}(?![A-Za-z0-9_])", text) for b in batch):
            df = df.withColumns(batch)
            batch = {}
        batch[name] = column
    return df.withColumns(batch) if batch else df


def rolling(
    df: DataFrame,
    build: WindowBuilder,
    *,
    back: int,
    fwd: int = 0,
    keys: Sequence[str] = KEYS,
    idx: str = "n",
    block: int = ROLL_BLOCK,
) -> DataFrame:
    """Evaluate fixed-row window columns over the blocked layout.

    ``build(w)`` yields ``(name, column)`` pairs in dependency order, where ``w`` is the
    ordered window of the block; frames must reach at most ``back`` rows behind and
    ``fwd`` rows ahead, counting chained windows together.
    """
    block = max(block, back, fwd, 1)
    lay = halo_layout(df, keys, idx, block, back, fwd)
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    lay = add_columns(lay, build(w))
    return lay.filter(~F.col("_halo")).drop("_blk", "_halo")


def trailing(w: Window, p: int) -> Window:
    """Frame of the last ``p`` rows including the current one."""
    return w.rowsBetween(-(p - 1), 0)


def masked(value: Column, x: Column, w: Window, p: int) -> Column:
    """``value`` where the trailing ``p``-row frame holds ``p`` non-null ``x``, else null."""
    return F.when(F.count(x).over(trailing(w, p)) == F.lit(p), value)


_SCAN_OPS = {
    "sum": (F.sum, lambda a, b: a + b, 0.0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "max": (F.max, F.greatest, None),
    "min": (F.min, F.least, None),
}


def prefix_scan(
    df: DataFrame,
    specs: Sequence[tuple[Column | str, str, str]],
    *,
    keys: Sequence[str] = KEYS,
    idx: str = "n",
    block: int = ROLL_BLOCK,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates from the start of each series: ``specs`` = (value, op, out),
    op in ``sum``/``product``/``max``/``min``.

    The unbounded-preceding frame is split: a running aggregate inside blocks of
    ``block`` rows, plus the aggregate of all earlier blocks taken from the block-total
    table (``block`` times smaller) and joined back on ``(key, block)``. All specs share
    one block-total aggregate, one carry window and one join. ``exclusive`` leaves the
    current row out.
    """
    base = df.withColumn("_sb", F.floor(F.col(idx) / F.lit(block)).cast("long"))
    base = base.withColumns({f"_sv{i}": F.col(v) if isinstance(v, str) else v for i, (v, _, _) in enumerate(specs)})
    totals = base.groupBy(*keys, "_sb").agg(
        *[_SCAN_OPS[op][0](f"_sv{i}").alias(f"_st{i}") for i, (_, op, _) in enumerate(specs)]
    )
    before = Window.partitionBy(*keys).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_sb", *[_SCAN_OPS[op][0](f"_st{i}").over(before).alias(f"_sc{i}") for i, (_, op, _) in enumerate(specs)]
    )
    inner = Window.partitionBy(*keys, "_sb").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = base.join(carry, [*keys, "_sb"], "left")
    drop = ["_sb"]
    new = {}
    for i, (_, op, name) in enumerate(specs):
        agg, combine, identity = _SCAN_OPS[op]
        a, c = agg(f"_sv{i}").over(inner), F.col(f"_sc{i}")
        if identity is None:
            res = F.when(a.isNull(), c).when(c.isNull(), a).otherwise(combine(a, c))
        else:
            res = combine(F.coalesce(a, F.lit(identity)), F.coalesce(c, F.lit(identity)))
        new[name] = res
        drop += [f"_sv{i}", f"_sc{i}"]
    return out.withColumns(new).drop(*drop)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, out: str = "m", total: str | None = None) -> DataFrame:
    """Dense 0-based position by an integer ``order`` column (chunks of ``CHUNK_BARS``), and ``total``: the key's rows."""
    return number_bars(df, keys, order=order, out=out, chunk=F.floor(F.col(order) / F.lit(CHUNK_BARS)), total=total)


class SeriesFrame:
    """A numbered series placed once in a halo layout; passes run inside it.

    All window passes and recurrence levels of a pipeline share one hash partitioning on
    ``keys + _blk``: window specs nest inside it, recurrence carries are small tables
    joined on ``keys + _blk + _b``. Halo rows carry values too, so chained passes see
    their neighbours; ``back`` must cover the longest chain of trailing frames plus one
    64-row block per recurrence level (the first block of a halo is not trusted), and
    ``fwd`` the longest leading frame.
    """

    LR_BLOCK = 64

    def __init__(self, df: DataFrame, *, back: int, fwd: int = 0, keys: Sequence[str] = KEYS,
                 idx: str = "n", block: int = ROLL_BLOCK):
        back = -(-back // self.LR_BLOCK) * self.LR_BLOCK
        self.block = max(block, back, fwd)
        self.keys, self.idx = list(keys), idx
        self.df = halo_layout(df, keys, idx, self.block, back, fwd)
        self.w = Window.partitionBy(*keys, "_blk").orderBy(idx)

    def windows(self, build: WindowBuilder) -> "SeriesFrame":
        self.df = add_columns(self.df, build(self.w))
        return self

    def columns(self, cols: dict) -> "SeriesFrame":
        self.df = self.df.withColumns(cols)
        return self

    def recur(self, recs) -> "SeriesFrame":
        from . import recurrence

        self.df = recurrence.run(self.df, recs, keys=self.keys, idx=self.idx, within="_blk",
                                 within_span=self.block)
        return self

    def result(self) -> DataFrame:
        return self.df.filter(~F.col("_halo")).drop("_blk", "_halo")
