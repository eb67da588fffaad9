"""A training corpus from documents: quality rules, near-dedup, secret scans, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in
the shared checkpoint folder and read again as the next stage's documents. All stages but the
last return the columns of documents:

1. quality rules: documents that the rules reject go;
2. near-dedup: of each class the document with the smallest doc_id stays, once;
3. secret scans: secrets are replaced by a mark, no document goes; n_chars follows the text;
4. mixing: a document stays as often as the mix takes it (no, one or up to three rows);
5. encoding: per remaining row doc_id, n_tokens and the digests of its ids and decoded text.

Null doc_ids: such rows belong to no class and can't be told apart, so stage 2 keeps them all.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import bpe, mixing, near_dedup, quality_rules, secret_scan
from candlewick.llm.common import few, written
from candlewick.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = written(near_dedup.classes(docs), "classes")
    stays = classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias("id_")).agg(F.count("*").alias("n_"))
    stays = few(written(stays, "stays"))
    rows = docs.join(stays, F.col("doc_id") == F.col("id_"))
    once = rows.where("n_ = 1").select(*COLUMNS)
    rest = F.min(F.struct(*COLUMNS[1:])).alias("r_")
    again = rows.where("n_ > 1").groupBy("doc_id").agg(rest).select("doc_id", *[f"r_.{c}" for c in COLUMNS[1:]])
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(docs)
    clean = secret_scan.redacted(F.col("text"), F.col("found"))
    out = found.withColumn("text", clean)
    return out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    mixed = few(written(mixed, "copies")).select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), "copies")
    rows = docs.join(mixed, docs["doc_id"].eqNullSafe(F.col("id_")) & docs["source"].eqNullSafe(F.col("source_")))
    return rows.withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # after the other stages executors have little memory to spare
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tables=(40_000, 60_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("secret_scan", secrets),
    ("mixing", mixture),
    ("byte_bpe", encode),
]
#: Learned rules and sketches have no SQL; tests/llm compares the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
