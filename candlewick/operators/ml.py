"""Spark ML training, search, scoring and model bundles.

Every fit is a distributed Spark ML job; the driver only orchestrates the (small) search
loop, as ``CrossValidator`` does. Labels -1/0/1 map to indices 0/1/2 in fixed order.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import argmax_class
from ..operators.metrics import classification_report
from ..session import cut_lineage
from .series import number_rows

MIN_TRAIN_ROWS = 100
# Explicit class weights of the 30-feature model (label -> weight).
EXPLICIT_CLASS_WEIGHTS = {0: 0.5, 1: 4.0, -1: 2.0}
# The classes of a label index: Spark ML counts them from here, else up to the largest index that occurs.
CLASSES = {"ml_attr": {"type": "nominal", "vals": ["-1", "0", "1"]}}


def label_index(label: str = "label"):
    """-1/0/1 → 0/1/2."""
    return (F.col(label) + F.lit(1)).cast("double")


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """I4: weight = N / (k * N_class) from one aggregate over the classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy()  # over the class table: one row per class
    w = counts.select(
        label, (F.sum("_nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(out)
    )
    return df.join(w, label)


def explicit_weights(df: DataFrame, weights: dict[int, float] = EXPLICIT_CLASS_WEIGHTS, label: str = "label",
                     out: str = "weight") -> DataFrame:
    """I6."""
    expr = F.lit(1.0)
    for cls, wt in weights.items():
        expr = F.when(F.col(label) == cls, F.lit(wt)).otherwise(expr)
    return df.withColumn(out, expr)


@dataclass
class EnsembleParams:
    """I3/I4/I8 sizes; the defaults are quick, ``REFERENCE_PARAMS`` has the full sizes."""

    rf_trees: int = 30
    rf_depth: int = 8
    rf_min_leaf: int = 12
    gbt_iter: int = 15
    gbt_depth: int = 4
    gbt_step: float = 0.05
    subsample: float = 0.8
    feature_subset: str = "all"
    seed: int = 42


# Model sizes and search sizes (draws, folds) of the original training runs.
REFERENCE_PARAMS = EnsembleParams(rf_trees=500, rf_depth=12, gbt_iter=300, gbt_depth=6)
REFERENCE_SEARCH = {"gpu": (20, 5), "dev": (15, 5)}


def preparation(train: DataFrame, features: Sequence[str]) -> PipelineModel:
    """Ordered features as one vector, standardised by the training rows' mean and deviation."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(train)


def scaler_table(prep: PipelineModel, features: Sequence[str]) -> DataFrame:
    """feature, mean and sample deviation of the fitted preparation, one row per feature."""
    from pyspark.sql import SparkSession

    scaler = prep.stages[-1]
    rows = [(f, float(m), float(d)) for f, m, d in zip(features, scaler.mean.toArray(), scaler.std.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, mean double, std double")


def soft_vote(forest: Column, boosted: Sequence[Column]) -> Column:
    """Mean of the forest's probabilities and the normalised one-vs-rest scores."""
    total = boosted[0] + boosted[1] + boosted[2]
    share = [F.when(total > 0, x / total).otherwise(F.lit(1.0 / 3)) for x in boosted]
    return F.array(*[(forest[i] + share[i]) / F.lit(2.0) for i in range(3)])


@dataclass
class Ensemble:
    """Soft-vote bundle: one preparation, random forest + one-vs-rest boosted trees."""

    prep: PipelineModel
    rf: RandomForestClassificationModel
    gbts: list[GBTClassificationModel]
    features: list[str]
    prob_threshold: float | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """I5 + I10: adds ``probs`` and ``pred``."""
        spare = ("rawPrediction", "probability", "prediction")
        scored = self.rf.transform(self.prep.transform(df)).withColumn("_p_rf", vector_to_array("probability")).drop(*spare)
        for i, m in enumerate(self.gbts):
            scored = m.transform(scored).withColumn(f"_g{i}", vector_to_array("probability")[1]).drop(*spare)
        out = scored.withColumn("probs", soft_vote(F.col("_p_rf"), [F.col(f"_g{i}") for i in range(3)]))
        out = out.withColumn("pred", argmax_class("probs"))
        return out.drop("_raw", "features", "_p_rf", *[f"_g{i}" for i in range(3)])


def fit_ensemble(train: DataFrame, features: Sequence[str], params: EnsembleParams | None = None,
                 weight_col: str | None = "weight") -> Ensemble | None:
    """I12 guard, then one preparation and, on its written rows, the forest and three binary boosted models."""
    p = params or EnsembleParams()
    if train.limit(MIN_TRAIN_ROWS).count() < MIN_TRAIN_ROWS:
        return None
    prep = preparation(train, features)
    weighted = bool(weight_col and weight_col in train.columns)
    data = prep.transform(train).withColumn("_y", label_index()).withMetadata("_y", CLASSES)
    data = cut_lineage(data.select("features", "label", "_y", *([weight_col] if weighted else [])), "train_rows")
    rf = RandomForestClassifier(
        labelCol="_y", featuresCol="features", numTrees=p.rf_trees, maxDepth=p.rf_depth,
        minInstancesPerNode=p.rf_min_leaf, seed=p.seed, subsamplingRate=1.0,
    )
    if weighted:
        rf.setWeightCol(weight_col)
    gbts = []
    for cls in (-1, 0, 1):
        gbt = GBTClassifier(labelCol="_yb", featuresCol="features", maxIter=p.gbt_iter, maxDepth=p.gbt_depth, stepSize=p.gbt_step,
                            subsamplingRate=p.subsample, featureSubsetStrategy=p.feature_subset, seed=p.seed)
        gbts.append(gbt.fit(data.withColumn("_yb", (F.col("label") == cls).cast("double"))))
    return Ensemble(prep, rf.fit(data), gbts, list(features))


def fit_per_symbol(train: DataFrame, features: Sequence[str], symbols: Sequence[str], params: EnsembleParams | None = None) -> dict[str, Ensemble | None]:
    """I12 per symbol: a model for every configured symbol, None for one with too few rows."""
    return {s: fit_ensemble(balanced_weights(train.filter(F.col("symbol") == s)), features, params) for s in symbols}


def expanding_folds(df: DataFrame, n_folds: int = 5, keys=("symbol", "tf"), order: str = "n") -> DataFrame:
    """I7 folds by position: fold i trains on rows before ``(i+1)*size`` and tests on the next
    ``size`` rows, ``size = rows // (n_folds + 1)`` per series."""
    df = number_rows(df, list(keys), order, out="_m")
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(n_folds + 1)).cast("long").alias("_fs"))
    return df.join(sizes, list(keys))


def random_search(train: DataFrame, features: Sequence[str], grid: dict[str, list], draws: int = 4,
                  n_folds: int = 3, seed: int = 42) -> tuple[dict, list[tuple[dict, float]], Ensemble | None]:
    """Sampled parameter maps × expanding-window folds, scored by macro-F1; the best map refitted on all rows.

    ``REFERENCE_SEARCH`` has the original numbers of draws and folds.
    """
    rng = random.Random(seed)
    folds = cut_lineage(expanding_folds(train, n_folds), "folds")
    scores = []
    for _ in range(draws):
        choice = {k: rng.choice(v) for k, v in grid.items()}
        params = EnsembleParams(**choice)
        f1s = []
        for i in range(n_folds):
            cut = F.col("_fs") * F.lit(i + 1)
            tr = folds.filter(F.col("_m") < cut)
            te = folds.filter((F.col("_m") >= cut) & (F.col("_m") < cut + F.col("_fs")))
            model = fit_ensemble(tr, features, params, weight_col=None)
            if model is None:
                continue
            rep = classification_report(model.predict(te), "label", "pred").collect()[0]
            f1s.append(rep["macro_f1"])
        scores.append((choice, sum(f1s) / len(f1s) if f1s else 0.0))
    best = max(scores, key=lambda s: s[1])[0]
    return best, scores, fit_ensemble(train, features, EnsembleParams(**best), weight_col=None)


def feature_importances(model: Ensemble) -> list[tuple[str, float]]:
    """RF importances, descending."""
    imp = model.rf.featureImportances.toArray()
    return sorted(zip(model.features, map(float, imp)), key=lambda x: -x[1])


def save_bundle(model: Ensemble, base: str, symbol: str) -> str:
    """One folder per symbol: preparation, RF and GBT models + metadata JSON (ordered features)."""
    from pyspark.sql import SparkSession

    path = os.path.join(base, f"symbol={symbol}")
    model.prep.write().overwrite().save(os.path.join(path, "prep"))
    model.rf.write().overwrite().save(os.path.join(path, "rf"))
    for i, g in enumerate(model.gbts):
        g.write().overwrite().save(os.path.join(path, f"gbt{i}"))
    meta = {"feature_names": model.features, "prob_threshold": model.prob_threshold}
    ss = SparkSession.active()
    # written last: a bundle without it counts as not trained
    ss.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(os.path.join(path, "meta"))
    return path


def load_bundle(base: str, symbol: str) -> Ensemble | None:
    """Missing bundle → None (untrained); optional keys default. Other read failures are raised."""
    from pyspark.sql import SparkSession

    path = os.path.join(base, f"symbol={symbol}")
    try:
        meta = json.loads(SparkSession.active().read.text(os.path.join(path, "meta")).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Ensemble(
        PipelineModel.load(os.path.join(path, "prep")), RandomForestClassificationModel.load(os.path.join(path, "rf")),
        [GBTClassificationModel.load(os.path.join(path, f"gbt{i}")) for i in range(3)],
        meta.get("feature_names", []), meta.get("prob_threshold"))
