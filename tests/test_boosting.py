"""Softmax boosted trees for many models at once against a plain numpy version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import boosting as BO
from candlewick.operators.boosting import BoostParams
from plain_boost import binned, macro_f1, plain_fit

FEATURES = ["a", "b", "c"]


def data(seed, sizes):
    """Rows (model, id, label, weight, a, b, c); every seventh row is only scored."""
    r = random.Random(seed)
    rows = []
    for model, n in sizes.items():
        for i in range(n):
            a, b, c = r.gauss(0, 1), r.choice((0.0, 1.0, 2.0)), r.random()
            label = 1 if a + 0.3 * r.gauss(0, 1) > 0.6 else -1 if b * c > 1 else 0
            rows.append((model, i, label, 0.0 if i % 7 == 0 else (0.5, 4.0, 2.0)[label], a, b, c))
    return rows


SCHEMA = "model string, id long, label int, weight double, a double, b double, c double"


def plain(rows, model, edges, p):
    mine = [x for x in rows if x[0] == model]
    x = np.array([q[4:] for q in mine])
    ids, label, weight = [q[1] for q in mine], np.array([q[2] for q in mine]), np.array([q[3] for q in mine])
    trees, probs = plain_fit(ids, binned(x, edges), label, weight, p)
    return trees, dict(zip(ids, probs))


@pytest.fixture(scope="module")
def fitted(spark):
    sizes = {"big": 900, "mid": 260, "small": 130, "few": 90}
    params = {
        "big": BoostParams(rounds=3, depth=3, eta=0.3, subsample=1.0), "mid": BoostParams(rounds=2, depth=2, eta=0.1, subsample=0.8, colsample=0.6),
        "small": BoostParams(rounds=1, depth=3, eta=0.5, subsample=1.0, lam=0.5, min_child=5.0), "few": BoostParams(rounds=3, depth=3),
    }
    rows = data(1, sizes)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, params, df, BO.fit(df, FEATURES, BO.params_table(spark, params), bins=8)


def edges_of(model, name):
    return next(r.edges for r in model._table("edges").collect() if r.model == name)


@pytest.mark.parametrize("name", ["big", "mid", "small"])
def test_trees_and_probabilities_equal_plain_ones(fitted, name):
    rows, params, _, model = fitted
    trees, probs = plain(rows, name, edges_of(model, name), params[name])
    got = {(r["round"], r.k, r.node): r for r in model.trees().where(F.col("model") == name).collect()}
    assert set(got) == set(trees)
    for at, (split, f, b, left, right) in trees.items():
        r = got[at]
        assert r.split == split and r.left == pytest.approx(left, abs=1e-12)
        if split:
            assert (r.f, r.bin) == (f, b) and r.right == pytest.approx(right, abs=1e-12)
    scored = {r.id: r.probs for r in model.scored_rows().where(F.col("model") == name).collect()}
    assert set(scored) == set(probs)
    assert all(scored[i] == pytest.approx(list(p), abs=1e-9) for i, p in probs.items())


def test_too_few_rows_are_not_trained(fitted):
    model = fitted[3]
    assert {r.model for r in model.trees().select("model").distinct().collect()} == {"big", "mid", "small"}


def test_one_model_alone_gives_the_same_trees(spark, fitted):
    _, params, df, model = fitted
    alone = BO.fit(df.where("model = 'big'"), FEATURES, BO.params_table(spark, {"big": params["big"]}), bins=8)
    cols = ["round", "level", "k", "node", "split", "f", "bin", "left", "right"]
    assert sorted(alone.trees().select(*cols).collect()) == sorted(model.trees().where("model = 'big'").select(*cols).collect())


def test_saved_bundle_scores_as_fitted(spark, fitted, monkeypatch):
    _, _, df, model = fitted
    monkeypatch.setattr(BO, "SCORE_BLOCK", 100)
    again = BO.Boosted.load(spark, model.path)
    got = {(r.model, r.id): r.probs for r in again.predict(df).collect()}
    expected = {(r.model, r.id): r.probs for r in model.scored_rows().collect()}
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)
    assert BO.Boosted.load(spark, model.path + "-none") is None


def test_importances(fitted):
    rows = fitted[3].importances().where("model = 'big'").collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert max(rows, key=lambda r: r.importance).feature == "a"


def test_empty_table(spark):
    model = BO.fit(spark.createDataFrame([], SCHEMA), FEATURES, BO.params_table(spark, {"x": BoostParams(rounds=2)}))
    assert model.scored_rows().collect() == []


def test_width_edges(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(5)] + [("n", 2.0)], "model string, a double")
    got = {r.model: r.edges for r in BO.width_edges(df, ["a"], bins=4).collect()}
    assert got == {"m": [[1.0, 2.0, 3.0]], "n": [[2.0, 2.0, 2.0]]}


def series_rows(spark, n):
    rows = [("s" if i % 3 else "t", "D1", i // 3 if i % 3 == 0 else i - i // 3 - 1, *x[1:]) for i, x in enumerate(data(2, {"x": n}))]
    return rows, spark.createDataFrame(rows, "symbol string, tf string, m long, id long, label int, weight double, a double, b double, c double").withColumn("weight", F.lit(1.0))


def test_folds(spark):
    rows, df = series_rows(spark, 200)
    got = BO.fold_rows(df, 4).groupBy("symbol", "fold").agg(F.min("m"), F.max("m"), F.min(F.when(F.col("weight") == 0, F.col("m"))), F.count("*")).collect()
    for symbol, fold, first, last, test, k in got:
        n = sum(r[0] == symbol for r in rows)
        start = n - (4 - fold) * (n // 5)
        assert (first, test, last, k) == (0, start, start + n // 5 - 1, start + n // 5)
    assert len(got) == 8


def test_search_equals_a_plain_loop(spark):
    rows, df = series_rows(spark, 600)
    grid = {"rounds": [1, 2], "depth": [1, 2], "eta": [0.3], "subsample": [0.8, 1.0], "colsample": [0.7, 1.0]}
    candidates = BO.draws(grid, 3)
    assert len(set(candidates)) == 3 and BO.draws(grid, 3) == candidates and len(BO.draws(grid, 99)) == 16
    scores = BO.search(df, FEATURES, candidates, 3, edges=BO.width_edges, bins=6, least_rows=20).collect()
    assert len(scores) == 2 * 3 * 3
    for r in scores:
        mine = sorted((x for x in rows if x[0] == r.symbol), key=lambda x: x[2])
        size = len(mine) // 4
        start = len(mine) - (3 - r.fold) * size
        x = np.array([q[6:] for q in mine])[: start + size]
        edges = [lo + (hi - lo) * np.arange(1, 6) / 6.0 for lo, hi in zip(x[:start].min(axis=0), x[:start].max(axis=0))]
        weight = np.array([1.0] * start + [0.0] * size)
        label = np.array([q[4] for q in mine])[: start + size]
        _, probs = plain_fit([q[3] for q in mine][: start + size], binned(x, edges), label, weight, candidates[r.draw])
        assert r.macro_f1 == pytest.approx(macro_f1(label[start:], probs[start:].argmax(axis=1) - 1), abs=1e-9)
    by = {}
    for r in scores:
        by.setdefault((r.symbol, r.draw), []).append(r.macro_f1)
        assert r.score == pytest.approx(np.mean([q.macro_f1 for q in scores if (q.symbol, q.draw) == (r.symbol, r.draw)]))
    best = {r.symbol: r.draw for r in BO.best_draws(spark.createDataFrame(scores)).collect()} if scores else {}
    for s in ("s", "t"):
        assert np.mean(by[s, best[s]]) == pytest.approx(max(np.mean(v) for (q, _), v in by.items() if q == s))


def test_rows_dealt_by_model_give_the_same_trees(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"m{i % 9}", i, r.choice((-1, 0, 1)), 1.0 if i % 5 else 0.0, r.random(), r.random()) for i in range(1350)]
    table = spark.createDataFrame(rows, "model string, id long, label int, weight double, a double, b double")
    sizes = BO.with_params(table.select("model").distinct(), BO.BoostParams(rounds=2, depth=2, eta=0.3, subsample=1.0))
    assert BO._one_part_each(120, 1080, 4) and not BO._one_part_each(600, 1080, 4)
    found = []
    for dealt in (True, False):
        monkeypatch.setattr(BO, "_one_part_each", lambda *a, dealt=dealt: dealt)
        fitted = BO.fit(table, ["a", "b"], sizes, BO.width_edges, bins=8)
        found.append((sorted(map(str, fitted.trees().collect())), sorted(map(str, fitted.scored_rows().collect()))))
    assert found[0] == found[1] and found[0][0]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("boosted_")]


def test_models_grown_whole_equal_those_grown_by_level(spark, monkeypatch):
    rows = data(4, {"a": 700, "b": 260, "c": 150, "d": 150, "none": 40})
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    params = {"a": BoostParams(rounds=2, depth=3, eta=0.3, subsample=0.7), "b": BoostParams(rounds=3, depth=1, eta=0.2, subsample=1.0, colsample=0.5),
              "c": BoostParams(rounds=1, depth=2, eta=0.5, subsample=1.0, min_child=60.0), "d": BoostParams(rounds=2, depth=2, subsample=0.0), "none": BoostParams(rounds=2)}
    cols = ["model", "round", "level", "k", "node", "split", "f", "bin", "left", "right", "gain"]
    found = []
    for most in (1 << 16, 0, 300):  # all grown whole, none, all but the largest
        monkeypatch.setattr(BO, "WHOLE_ROWS", most)
        fitted = BO.fit(df, FEATURES, BO.params_table(spark, params), BO.width_edges, bins=8)
        monkeypatch.setattr(BO, "SCORE_BLOCK", 4096 if most else 200)
        again = {(r.model, r.id): r.probs for r in BO.Boosted.load(spark, fitted.path).predict(df).collect()}
        scored = {(r.model, r.id): r.probs for r in fitted.scored_rows().collect()}
        assert again.keys() == scored.keys() and all(again[k] == pytest.approx(scored[k], abs=1e-12) for k in again)
        found.append((sorted(map(tuple, fitted.trees().select(*cols).collect())), scored))
    assert {t[0] for t in found[0][0]} == {"a", "b", "c"} and {m for m, _ in found[0][1]} == {"a", "b", "c", "d"}
    for trees, scored in found[1:]:
        assert [t[:8] for t in trees] == [t[:8] for t in found[0][0]]
        assert all(x[8:] == pytest.approx(y[8:], abs=1e-12) for x, y in zip(trees, found[0][0]))
        assert scored.keys() == found[0][1].keys() and all(scored[k] == pytest.approx(found[0][1][k], abs=1e-12) for k in scored)


def test_small_models_take_as_many_jobs_whatever_their_rounds(spark, monkeypatch):
    df = spark.createDataFrame(data(5, {f"m{i}": 120 for i in range(6)}), SCHEMA)
    sc, jobs = spark.sparkContext, []
    for rounds in (1, 6):
        sc.setJobGroup(f"rounds {rounds}", "")
        fitted = BO.fit(df, FEATURES, BO.params_table(spark, {f"m{i}": BoostParams(rounds=rounds, depth=2) for i in range(6)}), bins=8)
        assert fitted.trees().select("model", "round").distinct().count() == 6 * rounds
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds {rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2


def test_whole_models_keep_nulls_and_values_without_order(spark):
    from candlewick.operators.boosting import _bin_places, _crc_on, _read_edges
    import pyarrow as pa
    import zlib

    inf, nan = float("inf"), float("nan")
    for id_ in ("7", "a b", ""):
        assert _crc_on(np.array([zlib.crc32(id_.encode())]), b":12").tolist() == [zlib.crc32(f"{id_}:12".encode())]
    values = [None, nan, -inf, -1.0, 0.5, 2.0, 3.0, inf]
    df = spark.createDataFrame([(m, i, v) for m in "xy" for i, v in enumerate(values)], "model string, id int, a double")
    edges = spark.createDataFrame([("x", [[0.0, 2.0, inf]]), ("y", [[None, nan, 1.0]])], "model string, edges array<array<double>>")
    expected = {(r.model, r.id): r.bins[0] for r in BO._binned(df, edges, ["a"]).collect()}
    table = pa.table({"x0": pa.array(values * 2, pa.float64())})
    heads = [np.array([3, 0.0, 2.0, inf]), np.array([3, nan, nan, 1.0])]
    got = _bin_places(table, _read_edges(heads, 1), np.repeat([0, 1], len(values)))[0].tolist()
    assert got == [expected[m, i] for m in "xy" for i in range(len(values))]


def test_whole_models_without_a_split_are_a_root():
    one = {"depth": np.array([2]), "lam": np.array([1.0]), "min_child": np.array([1.0])}
    value, nodes = BO._grow_tree(np.array([[3, 2, 3]]), np.zeros(3, dtype=int), np.array([0.5, 0.25, 0.25]), np.array([0.5, 0.25, 0.25]), np.array([True, True, False]), one, np.array([[True]]))
    assert value.tolist() == [-0.75 / 1.75] * 3
    assert [[x.tolist() for x in n] for n in nodes] == [[[0], [0], [1], [False], [0], [2], [-0.75 / 1.75], [-0.5 / 1.5], [0.0]]]
