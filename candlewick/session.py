"""Session settings every job relies on.

Jobs never build their own session on a cluster: they take the caller's session and
only pin the settings results depend on (UTC wall clock, ANSI arithmetic). The
checkpoint folder is read from the session (``spark.checkpoint.dir``); a private one is
created only when the session runs in local mode and has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
# Only for sessions this module builds; a caller's planner settings stay as they are.
_PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # wide window plans: constraint propagation costs seconds of planning and prunes nothing here
    "spark.sql.constraintPropagation.enabled": "false",
    # joins on (key, block, sub-block) keep an existing (key, block) partitioning
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench: local mode, no UI, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("candlewick")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call-site capture costs three JVM round trips per column function while a plan is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in (_PINNED | _PLANNING).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (UTC wall clock, ANSI arithmetic) on a caller's session; idempotent."""
    for k, v in _PINNED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring the context from the session.

    On a cluster the folder must be set by the operator (``spark.checkpoint.dir``) and
    point at shared storage. Only a local-mode session without one gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at shared storage for this cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="candlewick-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One computation (an RDD checkpoint computes its plan twice), survives executor loss,
    and later plans start from a plain scan, so planning time stays flat.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
