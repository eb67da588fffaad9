"""Models of training rows in which a class does not occur, of too few rows, and from any thread."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from candlewick import session
from candlewick.operators import ml as ML
from candlewick.plans import catalog

DAYS = 520
SCORES = [("symbol", "string"), ("tf", "string"), ("time", "timestamp_ntz"), ("n", "bigint"), ("label", "int"), ("pred", "int"), ("gated", "int")]


def flat_line_items(spark, path, n_days):
    d = F.col("id")
    prices = F.array(1495.0 + d * 29 % 13, 2000.0 + d * 13 % 7, 1000.0 - d * 17 % 5, 1495.0 + d * 37 % 11)
    days = spark.range(n_days).select("id", F.posexplode(prices).alias("i", "price"))
    days.select(
        (d * 4 + F.col("i")).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey"), F.lit("A").alias("l_returnflag"),
        F.lit(1.0).alias("l_quantity"), F.col("price").alias("l_extendedprice"),
        F.timestamp_seconds(d * 86400).alias("l_shipdate")).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture(scope="module")
def flat_tables(spark, tmp_path_factory):
    """Line items whose daily range is far wider than any move of the closes: every bar has label 0."""
    return flat_line_items(spark, str(tmp_path_factory.mktemp("flat")), DAYS)


@pytest.mark.parametrize("labels", [(-1, 0), (0,), (-1,), (0, 1)])
def test_every_model_has_three_classes(spark, labels):
    k = F.col("id") % len(labels)
    rows = spark.range(200).select(F.array(*map(F.lit, labels))[k.cast("int")].alias("label"), (k + F.col("id") % 7 / 100).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    model = ML.fit_ensemble(ML.balanced_weights(rows), ["a", "b"], ML.EnsembleParams(rf_trees=3, rf_depth=3, gbt_iter=3, gbt_depth=2))
    assert model.rf.numClasses == 3
    for r in model.predict(rows).collect():
        assert len(r.probs) == 3 and abs(sum(r.probs) - 1.0) < 1e-9
        assert r.pred == r.label
        # the forest, one half of the vote, gives an absent class nothing
        assert all(r.probs[c + 1] < 0.5 for c in {-1, 0, 1} - set(labels))


def test_ensemble_query_without_buy_and_sell_labels(spark, flat_tables):
    rows = catalog.q_ml_ensemble_v11(spark, flat_tables).collect()
    assert rows and {(r.label, r.pred, r.gated) for r in rows} == {(0, 0, 0)}
    assert all(abs(r.p_sell + r.p_hold + r.p_buy - 1.0) < 1e-9 for r in rows)


def test_streamed_scores_without_buy_and_sell_labels(spark, flat_tables):
    rows = catalog.q_stream_model_scores(spark, flat_tables).collect()
    assert rows and {(r.label, r.pred, r.gated) for r in rows} == {(0, 0, 0)}


@pytest.mark.parametrize("n_days,n_scored", [(240, 6), (0, 0)])
def test_streamed_scores_of_too_few_rows_are_holds(spark, tmp_path, n_days, n_scored):
    found = catalog.q_stream_model_scores(spark, flat_line_items(spark, str(tmp_path), n_days))
    assert [(r.label, r.pred, r.gated) for r in found.collect()] == [(0, 0, 0)] * n_scored
    assert found.dtypes == SCORES


def test_streamed_scores_below_a_folder_whose_name_urls_encode(spark, flat_tables, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: f"file://{tmp_path}/a folder, 5% +1")
    found = catalog.q_stream_model_scores(spark, flat_tables)
    rows = found.collect()
    assert rows and {(r.label, r.pred, r.gated) for r in rows} == {(0, 0, 0)}
    assert found.dtypes == SCORES


def test_bundles_and_scaler_tables_in_a_thread_without_an_active_session(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3 - 1).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"))

    def kept():
        model = ML.fit_ensemble(rows, ["a"], ML.EnsembleParams(rf_trees=2, rf_depth=2, gbt_iter=2, gbt_depth=2))
        ML.save_bundle(model, str(tmp_path), "A")
        return ML.load_bundle(str(tmp_path), "A").features, ML.scaler_table(model.prep, ["a"]).count()

    with ThreadPoolExecutor(1) as pool:
        assert pool.submit(kept).result() == (["a"], 1)
