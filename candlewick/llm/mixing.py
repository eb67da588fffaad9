"""Mixing sources to target weights by hash-threshold histograms.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... (``weights``) and share
``share`` of all words. No target exceeds ``max_repeats`` times its source's words; what
exceeds it is shared again by weight. A source with target / words = whole + rest is taken
``whole`` times, and for the rest once more those documents whose hash lies under a
threshold. The threshold is found without sorting: words are summed by source and hash
bucket (10 bits), the bucket in which the budget ends is the only one refined by the next
10 bits, and so on for 60 bits. Thresholds of growing budgets are nested: a document
taken for a budget is taken for every larger one. The last group of equal hashes is taken
if that comes nearer to the budget.

Only narrow rows (source, hash, words) are ever shuffled, summed before the shuffle, so a
source with a third of all rows costs no more than 1,024 sums per level. The table of
sources (one row each) is the only thing ordered as a whole.

Edge cases: null text has no words; a document without words is taken but adds nothing;
null source is a source of its own, after all others; rows with equal doc_id share a hash
and so the same fate; an empty table gives an empty table; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.common import n_words, written

BITS, LEVELS = 10, 6
SEED = "mix"
#: The weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)


def unit_hash(key: str = "doc_id", seed: str = SEED) -> Column:
    """60 bits of a document's key, the same on every engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """source, source_size, target. ``sizes`` has one row per source: source, source_size.

    A source whose limit per weight is at most the common level is capped; the level shares
    what the capped ones leave among the others. Walking the sources by limit per weight,
    the level is that of the first source that stays under its limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    ranked = ranked.withColumn("limit", max_repeats * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    every = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = left.cast("double") / rest
    ranked = ranked.withColumn("level", F.when(F.col("limit") > level * F.col("weight"), level))
    # among sources under their limit with the same limit per weight the levels agree up to rounding
    ranked = ranked.withColumn("common", F.min(F.when(F.col("level").isNotNull(), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"])
    raised = F.col("common") * F.col("weight")
    target = F.when(F.col("common").isNull() | (raised > F.col("limit")), F.col("limit").cast("double")).otherwise(raised)
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """source, whole, cut: hashes under ``cut`` are taken once more. ``narrow``: source, h, size."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = written(
        goal.withColumn("whole", F.floor(ratio)).select(
            "source", "source_size", "target", "whole", F.lit(0).cast("long").alias("low"),
            (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"), F.lit(False).alias("done"),
        ),
        "mix-state",
    )
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        # the open range of a source is [low, low + 2^(shift + BITS)): one bucket of the level before
        inside = narrow.join(state.select(F.col("source").alias("s"), "low", "done"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where(~F.col("done") & (F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS)))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("through", F.sum("size").over(upto))
        sums = sums.withColumnRenamed("source", "s")
        ends = sums.join(state.select(F.col("source"), "budget"), F.col("s").eqNullSafe(F.col("source"))).where(F.col("through") > F.col("budget"))
        ends = ends.groupBy("s").agg(F.min(F.struct("bucket", "size", "through")).alias("e"))
        found = state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        step = F.col("done") | F.col("e").isNull()
        rest = F.col("budget") - (F.col("e.through") - F.col("e.size"))
        last = level == LEVELS - 1
        low = F.shiftleft(F.col("e.bucket"), shift)
        if last:  # one hash is left: take it if that is nearer
            low = low + F.when(2 * rest >= F.col("e.size"), F.lit(1)).otherwise(F.lit(0))
        everything = F.lit(1 << (BITS * LEVELS)).cast("long")
        state = written(
            found.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("done"), F.col("low")).when(F.col("e").isNull(), everything).otherwise(low).alias("low"),
                F.when(step, F.col("budget")).otherwise(rest).alias("budget"),
                step.alias("done"),
            ),
            "mix-state",
        )
    return state.select("source", "source_size", "target", "whole", F.col("low").alias("cut"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, source, ``keep``, size, source_size, target, copies and taken = copies * size per document."""
    rows = docs.select(key, "source", *keep, n_words(text).alias("size"), unit_hash(key).alias("h"))
    narrow = written(rows, "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = thresholds(narrow.select("source", "h", "size"), targets(sizes, weights, share, max_repeats))
    cuts = cuts.withColumnRenamed("source", "s")
    out = narrow.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.when(F.col("h") < F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    out = out.withColumn("copies", F.least(copies, F.lit(max_repeats)).cast("long"))
    return out.select(key, "source", *keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: The same mix by a full sort per source, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS lim, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY lim::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min(level) FILTER (WHERE lim > level * weight AND lim::DOUBLE / weight = (SELECT min(lim::DOUBLE / weight) FROM v WHERE lim > level * weight)) AS common FROM v),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR common * weight > lim THEN lim::DOUBLE ELSE common * weight END AS target FROM w, c),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT g.source, h, g.size, r.target - r.whole * r.source_size AS budget,
             sum(g.size) OVER (PARTITION BY g.source ORDER BY h) AS through
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
e AS (SELECT source, min(h) AS h FROM q WHERE through > budget GROUP BY source),
k AS (SELECT q.source, q.h, CASE WHEN e.h IS NULL OR q.h < e.h THEN 1 WHEN q.h > e.h THEN 0
             WHEN 2 * (budget - (through - size)) >= size THEN 1 ELSE 0 END AS once
      FROM q LEFT JOIN e ON q.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(d.size * least(3, r.whole + k.once) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
