"""Helpers shared by the operators: row-wise Arrow maps, word counts, scratch tables."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candlewick.session import ensure_checkpoint_dir

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Narrow rows (ids and numbers) up to which a written table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its counted rows allow it. Only for narrow, written tables."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: str | Column) -> Column:
    """Words of a text column as a long; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def release_memory() -> None:
    """Give a task's freed memory back to the machine: Python workers stay for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker: Spark reuses workers, so their later tasks find tables that earlier ones filled."""
    kept = sys.modules.setdefault("_candlewick_worker", types.ModuleType("_candlewick_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def map_documents(
    df: DataFrame,
    schema: str,
    factory: Callable[[], Callable[..., dict[str, list]]],
    step: int = 256,
) -> DataFrame:
    """Apply a Python function to blocks of ``step`` rows, partition by partition, over Arrow.

    ``factory`` runs once per task and returns a function that takes the columns of a block
    as Python lists and returns the output columns as lists or arrays. At most one block
    beside the Arrow batch is in memory as Python objects.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                apply = apply or factory()
                cols = apply(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)
                cols = None
        apply = batch = part = None
        release_memory()

    return df.mapInArrow(run, schema)
