"""Registered queries against their DuckDB oracles on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from candlewick.sources.tables import TABLES
from conftest import SF_SMALL

# the training-data queries have tests of their own
CHECKED = sorted(n for n in E.oracle_sql() if not n.startswith("op") and n != "pipeline")
WITHOUT_SQL = {"ml_ensemble_v11", "stream_model_scores", "ml_random_search"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    order = sorted(range(len(ocols)), key=lambda i: ocols[i])
    exp = sorted((tuple(_norm(r[i]) for i in order) for r in res.fetchall()), key=_key)
    assert got == exp


def test_every_query_is_registered_with_schema(spark):
    q = {n for n in E.queries() if not n.startswith("op") and n != "pipeline"}
    assert len(q) >= 70
    assert q - set(E.oracle_sql()) == WITHOUT_SQL


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 3
