"""Connected components of a link table, by alternating large and small stars.

Every round moves links towards each component's smallest node. Sums and minima are
combined before each shuffle, joins are equi-joins that adaptive execution can split, and
each round's links are written to the shared folder, so lineage stays short and lost
executors cost one round at most. Nothing but two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) for every node but the roots themselves."""
    ordered = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(ordered, "links")
    while True:
        # done when every node has one link, and that to a node without one
        many = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1).alias("x"))
        chained = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").select(F.lit(1).alias("x"))
        if many.unionByName(chained).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = written(_small(_large(now)), "links")
