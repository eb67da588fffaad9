"""A11, A13, K12 sinks: append-only tables in a shared folder.

Writes are partitioned so reruns replace whole partitions instead of duplicating rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(lines: DataFrame, path: str) -> None:
    """Append log lines (ts, symbol, level, msg) partitioned by day."""
    lines.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)



def write_backtest(curve: DataFrame, base: str, run_id: str) -> dict[str, str]:
    """The equity curve and the signal bars of a backtest run, as two tables."""
    paths = {"equity": os.path.join(base, "equity"), "signals": os.path.join(base, "signals")}
    tagged = curve.withColumn("run_id", F.lit(run_id))
    (tagged.select("run_id", "symbol", "tf", "time", "t", "ret", "strat_ret", "equity", "equity_bh")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(paths["equity"]))
    (tagged.filter(F.col("signal") != 0).select("run_id", "symbol", "tf", "time", "close", "signal")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(paths["signals"]))
    return paths


def write_intents(intents: DataFrame, path: str, batch_id: int) -> None:
    """K12 sink: order intents of one evaluation, replaced as a whole on replay."""
    (intents.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
