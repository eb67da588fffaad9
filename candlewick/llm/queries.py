"""The operators' registered queries (``QUERIES``) and their DuckDB counterparts (``ORACLES``)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import bpe, chat_format, html_text, improbable_digest, mixing, near_dedup, periodic_runs, quality_gam, quality_rules, secret_scan, spelling_variants, token_files, vector_search
from candlewick.sources.tables import read_table


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.format_conversations(read_table(spark, sf_dir, "conversations")))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read_table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.find(docs.select("doc_id", periodic_runs.planted().alias("text"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.counted_words(read_table(spark, sf_dir, "documents"), plant=True))


def op13_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable_digest.with_edits(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_vector_search, op2_mix_sources, op3_chat_format, op4_quality_gam, op5_token_files, op6_near_dedup, op7_secret_scan, op8_quality_rules, op9_byte_bpe, op10_html_text, op11_periodic_runs, op12_spelling_variants, op13_improbable_digest)}
ORACLES = {"op1_vector_search": vector_search.ORACLE, "op2_mix_sources": mixing.ORACLE, "op3_chat_format": chat_format.ORACLE, "op12_spelling_variants": spelling_variants.ORACLE}
