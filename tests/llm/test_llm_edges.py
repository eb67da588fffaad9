"""Every registered query on odd rows and on empty tables, against SQL or plain Python."""

import hashlib
import os
import sys

import duckdb
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from candlewick.llm import bpe, html_text  # noqa: E402
from candlewick.llm.queries import ORACLES, QUERIES  # noqa: E402
from llm_tables import TEXTS, plain_classes, plain_counts, plain_secrets, plain_token_rows, write_tables  # noqa: E402


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("edges")
    return write_tables(spark, f"{at}/rows"), write_tables(spark, f"{at}/none", rows=False)


def run(spark, folders, name):
    return QUERIES[name](spark, folders[0]).collect()


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, folders, name):
    rows = (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, folders[1]).collect()
    assert [r.conv_id for r in rows] == [-1] if name.startswith("op3_") else rows == []


@pytest.mark.parametrize("name", list(ORACLES))
def test_odd_rows_against_sql(spark, folders, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folders[0]}/{t}.parquet/*.parquet')")
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    rows = run(spark, folders, name)
    assert sorted(rows[0].asDict()) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(got.fetchall(), key=key)


def test_quality_rules(spark, folders):
    rows = run(spark, folders, "op8_quality_rules")
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows if r.doc_id)
    assert got == sorted((d, *plain_counts(t)) for d, t in TEXTS if d)
    assert len(rows) == len(TEXTS) and not any(r.kept for r in rows if r.base_failed)


def test_quality_gam(spark, folders):
    rows = run(spark, folders, "op4_quality_gam")
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows}[1] == (__import__("zlib").crc32(b"1") % 3 == 1)


def test_token_files(spark, folders):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, folders, "op5_token_files")), key=lambda r: r[1])
    assert got == plain_token_rows(TEXTS, tokenizer)


def test_secret_scan(spark, folders):
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run(spark, folders, "op7_secret_scan"))
    assert got == sorted((d or 0, *plain_secrets(t)) for d, t in TEXTS)


def test_byte_bpe(spark, folders):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(d, t):
        ids = e.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        return d or 0, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, folders, "op9_byte_bpe"))
    assert got == sorted(expected(d, t) for d, t in TEXTS)


def test_near_dedup(spark, folders):
    rows = run(spark, folders, "op6_near_dedup")
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == plain_classes([(d, t) for d, t in TEXTS if d != 6]) | {6: 6}


def test_html_text(spark, folders):
    rows = run(spark, folders, "op10_html_text")
    assert sorted((r.page_id or 0, r.text[:20], r.n_chars) for r in rows) == sorted(
        [(1, "hi", 2), (1, "hi", 2), (2, "", 0), (3, "", 0), (0, "a\n\nlong words, here.", 1 + 20_000 * 19)]
    )
    assert html_text.main_text(None) == ""


def test_pipeline_on_odd_rows(spark, folders):
    rows = corpus_pipeline.run(spark, folders[0]).collect()
    assert {r.doc_id for r in rows} <= {d for d, _ in TEXTS}
