"""Softmax boosted trees over binned features, many models in the same jobs.

One model per value of ``model`` (a symbol, or a symbol with its fold and draw). Models of at most
``WHOLE_ROWS`` rows meet in one shuffle by model; a task grows all trees of many such models
together, whatever their rounds and depths. Larger ones grow level by level: rows are summed to
(model, class, node, feature, bin) histograms of gradients and hessians, in one shuffle of partial
sums; running sums over the bins give the best split of a node. Rows of these never meet by model,
so a symbol with a third of all rows is spread like any other. Ten thousand symbols take as many
jobs as one. A few numbers (such as most rounds, most levels) reach the driver; trees are a table.

Gradients are rounded to multiples of 2^-20 and summed as whole numbers, so the same rows give the
same trees in any order and on any cluster.

Objective: softmax over the classes 0, 1, 2 (labels -1, 0, 1), one tree per class and round,
second order: gain ``gl^2/(hl+lam) + gr^2/(hr+lam) - g^2/(h+lam)``, leaf ``-g/(h+lam)``, hessian
``2 p (1-p)``; ties go to the first feature, then the lowest bin.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ml import MIN_TRAIN_ROWS

SCALE = float(1 << 20)
CLASSES = 3
#: Gains up to this are rounding, not splits.
MIN_GAIN = 1e-9
#: Rows of one level's table of splits.
SPLITS = "model string, k int, node int, split boolean, f int, bin short, left double, right double, gain double"
#: Rows of a model that are scored together with a copy of its trees.
SCORE_BLOCK = 4096
#: Most rows of a model whose trees grow in one task, and the weight below which its sums are exact as doubles.
WHOLE_ROWS, WHOLE_WEIGHT = 1 << 16, float(1 << 31)
#: Rows after which a task begins a new group of models to grow or score together.
TOGETHER = 1 << 16
#: What a model's first row of numbers holds before its edges.
HEAD = ("rounds", "depth", "eta", "lam", "min_child", "subsample", "colsample")
#: A tree's node as a row of numbers.
NODE = ("round", "level", "k", "node", "split", "f", "bin", "left", "right")


@dataclass(frozen=True)
class BoostParams:
    """Sizes of one model; the defaults are those of the original training run."""

    rounds: int = 300
    depth: int = 6
    eta: float = 0.05
    lam: float = 1.0
    min_child: float = 1.0
    subsample: float = 0.8
    colsample: float = 1.0


def params_table(spark: SparkSession, params: dict[str, BoostParams]) -> DataFrame:
    """``model`` and its sizes, one row each."""
    names = list(asdict(BoostParams()))
    rows = [(m, *[asdict(p)[n] for n in names]) for m, p in params.items()]
    return spark.createDataFrame(rows, "model string, rounds int, depth int, eta double, lam double, min_child double, subsample double, colsample double")


def with_params(models: DataFrame, params: BoostParams) -> DataFrame:
    """The same sizes for every row of ``models``."""
    cols = {"rounds": "int", "depth": "int", "eta": "double", "lam": "double", "min_child": "double", "subsample": "double", "colsample": "double"}
    return models.select("model", *[F.lit(getattr(params, n)).cast(t).alias(n) for n, t in cols.items()])


# --- bins -----------------------------------------------------------------------------------


def width_edges(rows: DataFrame, features: Sequence[str], bins: int = 32) -> DataFrame:
    """Per model and feature the inner edges of ``bins`` bins of equal width."""
    ends = rows.groupBy("model").agg(*[a(F.col(f).cast("double")).alias(f"{n}_{i}") for i, f in enumerate(features) for n, a in (("lo", F.min), ("hi", F.max))])

    def edges(i: int) -> Column:
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        return F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda j: lo + (hi - lo) * j.cast("double") / F.lit(float(bins)))

    return ends.select("model", F.array(*[edges(i) for i in range(len(features))]).alias("edges"))


def quantile_edges(rows: DataFrame, features: Sequence[str], bins: int = 32) -> DataFrame:
    """Per model and feature the inner quantiles, from mergeable sketches."""
    at = [j / bins for j in range(1, bins)]
    found = rows.groupBy("model").agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f"q_{i}") for i, f in enumerate(features)])
    return found.select("model", F.array(*[F.array_distinct(f"q_{i}") for i in range(len(features))]).alias("edges"))


def _binned(rows: DataFrame, edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``bins``: per feature the number of edges below the value."""
    def below(i: int, value: Column) -> Column:
        return F.size(F.filter(F.col("edges")[i], lambda e: e < value)).cast("short")

    cols = [below(i, F.col(f).cast("double")) for i, f in enumerate(features)]
    return rows.join(edges, "model").withColumn("bins", F.array(*cols)).drop("edges")


# --- trees ------------------------------------------------------------------------------------


def _by_model(splits: DataFrame, levels: int) -> DataFrame:
    """One row per model: ``tree``, its splits of this round as an array over class and node."""
    entry = F.struct((F.col("k") * F.lit(1 << levels) + F.col("node")).alias("key"), F.struct("split", "f", "bin", "left", "right").alias("value"))
    found = splits.groupBy("model").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    places = F.sequence(F.lit(0), F.lit(CLASSES * (1 << levels) - 1))
    return found.select("model", F.transform(places, lambda i: F.try_element_at("found", i)).alias("tree"))


def _walk(k: int, levels: int) -> Column:
    """Node, leaf value and whether the row is still on its way after ``levels`` levels of class ``k``'s tree."""
    zero = F.struct(F.lit(1).alias("node"), F.lit(0.0).alias("value"), F.lit(True).alias("live"))
    if not levels:
        return zero

    def out(node, value, live):
        return F.struct(node.alias("node"), value.alias("value"), F.lit(live).alias("live"))

    def step(a, _):
        e = F.get("tree", F.lit(k << levels) + a.node)
        return (
            F.when(~a.live | e.isNull(), out(a.node, a.value, False))
            .when(~e.split, out(a.node, e.left, False))
            .when(F.get("bins", e.f) > e.bin, out(a.node * 2 + 1, e.right, True))
            .otherwise(out(a.node * 2, e.left, True))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), zero, step)


def softmax(scores: Column | str = "scores") -> Column:
    """Probabilities of an array of three scores."""
    s = F.col(scores) if isinstance(scores, str) else scores
    top = F.greatest(s[0], s[1], s[2])
    e = [F.exp(s[i] - top) for i in range(CLASSES)]
    total = e[0] + e[1] + e[2]
    return F.array(*[x / total for x in e])


def _feature_turn(turn: int, k: int, n: int) -> list[int]:
    """Place of each feature in the order by which a tree of this round takes its share of the features."""
    order = sorted(range(n), key=lambda f: (zlib.crc32(f"{turn}:{k}:{f}".encode()), f))
    return [order.index(f) for f in range(n)]


def _histogram(state: DataFrame, tree: DataFrame | None, turn: int, level: int, n_features: int, by_share: bool) -> DataFrame:
    """Sums of gradients and hessians by model, class, node, feature and bin."""
    drawn = F.crc32(F.concat(F.col("id").cast("string"), F.lit(f":{turn}"))) % 1000 < F.col("subsample") * 1000
    rows = state.where((F.col("weight") > 0) & (F.col("rounds") > turn) & (F.col("depth") > level) & ((F.col("subsample") >= 1) | drawn))
    if tree is not None:
        rows = rows.join(tree, "model")
    rows = rows.withColumn("p", softmax())
    each = []
    for k in range(CLASSES):
        p, w = F.col("p")[k], F.col("weight")
        g = F.floor((p - (F.col("label") == k - 1).cast("double")) * w * SCALE + 0.5).cast("long")
        h = F.floor(F.lit(2.0) * p * (F.lit(1.0) - p) * w * SCALE + 0.5).cast("long")
        each.append(F.struct(F.lit(k).alias("k"), _walk(k, level).alias("at"), g.alias("g"), h.alias("h")))
    rows = rows.select("model", "bins", "colsample", F.explode(F.array(*each)).alias("c")).where("c.at.live")
    rows = rows.select("model", "colsample", F.col("c.k").alias("k"), F.col("c.at.node").alias("node"), F.col("c.g").alias("g"), F.col("c.h").alias("h"), F.posexplode("bins").alias("f", "bin"))
    if not by_share:
        return rows.groupBy("model", "k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    turns = F.array(*[F.array(*map(F.lit, _feature_turn(turn, k, n_features))) for k in range(CLASSES)])
    taken = F.get(F.get(turns, F.col("k")), F.col("f")) < F.ceil(F.col("colsample") * n_features)
    rows = rows.where((F.col("colsample") >= 1) | taken)
    return rows.groupBy("model", "k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _best_splits(hist: DataFrame, params: DataFrame, level: int, dealt: bool = False) -> DataFrame:
    """Per model, class and node its best split: feature, bin (greater goes right), values of both sides and gain.
    The root has a row in any case, a leaf's with ``split`` false."""
    node = ["model", "k", "node"]
    whole = Window.partitionBy(*node, "f")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # unless dealt by model already, histograms are dealt by node once, for the running sums and for the best of them
    rows = (hist if dealt else hist.repartition(*node)).select(*node, "f", "bin", F.sum("g").over(below).alias("gl_"), F.sum("h").over(below).alias("hl_"), F.sum("g").over(whole).alias("g_"),
                       F.sum("h").over(whole).alias("h_"), F.max("bin").over(whole).alias("last_"))
    rows = rows.join(params.select("model", "lam", "min_child"), "model")

    def units(x: Column) -> Column:
        return x.cast("double") / F.lit(SCALE)

    gl, hl, g, h = (units(F.col(c)) for c in ("gl_", "hl_", "g_", "h_"))
    gr, hr = units(F.col("g_") - F.col("gl_")), units(F.col("h_") - F.col("hl_"))
    lam, least = F.col("lam"), F.col("min_child")
    gain = gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam)
    fits = (F.col("bin") < F.col("last_")) & (hl >= least) & (hr >= least)
    gain = F.when(fits & (gain > MIN_GAIN), gain).otherwise(F.lit(0.0))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), (-gl / (hl + lam)).alias("left"),
                          (-gr / (hr + lam)).alias("right"), (-g / (h + lam)).alias("whole")))
    rows = rows.groupBy(*node).agg(best.alias("b"))
    split = F.col("b.gain") > 0
    rows = rows.select(*node, split.alias("split"), (-F.col("b.f")).alias("f"), (-F.col("b.bin")).cast("short").alias("bin"),
                       F.when(split, F.col("b.left")).otherwise(F.col("b.whole")).alias("left"), F.col("b.right").alias("right"), F.col("b.gain").alias("gain"))
    return rows if level == 0 else rows.where("split")


# --- whole models in a task -------------------------------------------------------------------


def _numbers(*cols: Column) -> Column:
    return F.array(*[c.cast("double") for c in cols])


def _head(edges: Column) -> Column:
    """Edges of all features as one row of numbers, each feature's count before its edges."""
    return F.flatten(F.transform(edges, lambda e: F.concat(_numbers(F.size(e)), e)))


def _read_edges(heads: list, n_features: int):
    """Edges by model, feature and place, filled up with NaN, from rows of numbers as ``_head`` makes them."""
    import numpy as np

    found = []
    for head in heads:
        at, mine = 0, []
        for _ in range(n_features):
            n = max(int(head[at]), 0)
            mine.append(head[at + 1: at + 1 + n])
            at += 1 + n
        found.append(mine)
    out = np.full((len(heads), n_features, max((len(e) for mine in found for e in mine), default=0)), np.nan)
    for i, mine in enumerate(found):
        for f, e in enumerate(mine):
            out[i, f, :len(e)] = e
    return out


def _bin_places(table, edges, m):
    """Per feature the bins of rows of models ``m``: the number of edges below the value. NaN is above all, null below all."""
    import numpy as np
    import pyarrow.compute as pc

    out = np.zeros((edges.shape[1], table.num_rows), dtype=np.int16)
    for f in range(edges.shape[1]):
        x = pc.fill_null(table[f"x{f}"], -np.inf).to_numpy()
        lost = np.isnan(x)
        x = np.where(lost, np.inf, x)
        for j in range(edges.shape[2]):
            e = edges[:, f, j][m]
            out[f] += (e < x) | (lost & (e == np.inf))
    return out


def _whole_groups(batches, keys: Sequence[str], together: int):
    """Sorted batches as tables of about ``together`` rows that end where the keys change, with each row's group from 0 on."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def groups(table):
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            c = table[k].combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            a, b = c.slice(1), c.slice(0, len(c) - 1)
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                new[1:] |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < together:
            continue
        table = pa.concat_tables(held).combine_chunks()
        at = groups(table)
        last = int(np.searchsorted(at, at[-1]))
        if last:
            yield table.slice(0, last), at[:last]
        held, n = [table.slice(last)], table.num_rows - last
    if n:
        table = pa.concat_tables(held).combine_chunks()
        yield table, groups(table)


def _heads(table, group, of):
    """The rows of numbers of the rows ``of`` and their groups."""
    import numpy as np
    import pyarrow.compute as pc

    at = np.flatnonzero(of)
    found = table["head"].take(at).combine_chunks()
    ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))
    return np.split(pc.list_flatten(found).to_numpy(zero_copy_only=False), ends[:-1]) if len(at) else [], group[at]


def _crc_on(crc, text: bytes):
    """CRC-32 of texts that go on with ``text``, from those so far."""
    import numpy as np

    turns = np.arange(256, dtype=np.int64)
    for _ in range(8):
        turns = np.where(turns & 1, (turns >> 1) ^ 0xEDB88320, turns >> 1)
    crc = crc ^ 0xFFFFFFFF
    for c in text:
        crc = turns[(crc ^ c) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _grow_tree(bins, m, g, h, train, size, taken):
    """One class's trees of a round for all models: each row's value, and the trees' nodes (model's place, level, node,
    split, f, bin, left, right, gain). As ``_best_splits``: ties go to the first feature, then the lowest bin."""
    import numpy as np

    n_models, d = taken.shape
    width = int(bins.max(initial=0)) + 1
    value, nodes = np.zeros(len(m)), []
    slot = m.copy()  # of a row's node, -1 at its end
    owner, node = np.arange(n_models), np.ones(n_models, dtype=np.int64)
    level = 0
    while len(owner):
        open_ = (size["depth"][owner] > level) & taken[owner].any(axis=1)
        slot[(slot >= 0) & ~open_[slot]] = -1
        rows = np.flatnonzero(train & (slot >= 0))
        if not len(rows):
            break
        s, g_, h_ = slot[rows], g[rows], h[rows]
        n = len(owner)
        lam, least = size["lam"][owner], size["min_child"][owner]
        gs, hs = (np.bincount(s, weights=x, minlength=n) for x in (g_, h_))
        whole = -gs / (hs + lam)
        gain, f_, bin_, left, right = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), whole.copy(), np.zeros(n)
        for f in range(d):
            places = s * width + bins[f, rows]
            gl, hl = (np.bincount(places, weights=x, minlength=n * width).reshape(n, width).cumsum(axis=1) for x in (g_, h_))
            gr, hr = gs[:, None] - gl, hs[:, None] - hl
            c, e = lam[:, None], least[:, None]
            found = gl * gl / (hl + c) + gr * gr / (hr + c) - (gs * gs / (hs + lam))[:, None]
            found = np.where((hl >= e) & (hr >= e) & (found > MIN_GAIN) & taken[owner, f][:, None], found, 0.0)
            at = found.argmax(axis=1)
            one = np.arange(n)
            better = found[one, at] > gain
            i, j = one[better], at[better]
            gain[i], f_[i], bin_[i] = found[i, j], f, j
            left[i], right[i] = -gl[i, j] / (hl[i, j] + lam[i]), -gr[i, j] / (hr[i, j] + lam[i])
        split = gain > 0
        kept = split
        if level == 0:  # a root has a node in any case, as if cut after its lowest bin
            kept = np.bincount(s, minlength=n) > 0
            f_ = np.where(split, f_, taken.argmax(axis=1))
            lone = ~split[s]
            mine, b = s[lone], bins[f_[s[lone]], rows[lone]]
            low = np.full(n, width, dtype=np.int64)
            np.minimum.at(low, mine, b)
            first = b == low[mine]
            gl, hl = (np.bincount(mine[first], weights=x[lone][first], minlength=n) for x in (g_, h_))
            bin_ = np.where(split, bin_, low)
            right = np.where(split, right, -(gs - gl) / (hs - hl + lam))
        i = np.flatnonzero(kept)
        nodes.append((owner[i], np.full(len(i), level), node[i], split[i], f_[i], bin_[i], left[i], right[i], gain[i]))
        rows = np.flatnonzero(slot >= 0)
        s = slot[rows]
        on = split[s]
        if level == 0:
            value[rows] = np.where(kept[s], left[s], 0.0)
        slot[rows[~on]] = -1
        rows, s = rows[on], s[on]
        up = bins[f_[s], rows] > bin_[s]
        value[rows] = np.where(up, right[s], left[s])
        slot[rows] = 2 * (np.cumsum(split) - 1)[s] + up
        owner = np.repeat(owner[split], 2)
        node = np.repeat(2 * node[split], 2) + np.tile((0, 1), int(split.sum()))
        level += 1
    return value, nodes


def _grow_models(batches, n_features: int, together: int):
    """Trees and scored rows of models whose rows, after a row of sizes and edges each, are sorted by model."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = {"k": pa.int32(), "node": pa.int32(), "split": pa.bool_(), "f": pa.int32(), "bin": pa.int16(), "left": pa.float64(), "right": pa.float64(), "gain": pa.float64(),
             "round": pa.int32(), "level": pa.int32()}
    row = {"label": pa.int32(), "weight": pa.float64()} | {f"s{k}": pa.float64() for k in range(CLASSES)}

    def out(n, **cols):
        kinds = {"model": table["model"].type} | plain | {"id": table["id"].type} | row
        return pa.RecordBatch.from_arrays([cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    for table, group in _whole_groups(batches, ["model"], together):
        is_head = table["kind"].to_numpy() == 0
        heads, owners = _heads(table, group, is_head)
        if not heads:
            continue
        names = table["model"].take(np.flatnonzero(is_head)).combine_chunks()
        size = {c: np.array([x[i] for x in heads]) for i, c in enumerate(HEAD)}
        place = np.full(int(group[-1]) + 1, -1)
        place[owners] = np.arange(len(heads))
        rows = np.flatnonzero(~is_head & (place[group] >= 0))
        m, table = place[group[rows]], table.take(rows).combine_chunks()
        bins = _bin_places(table, _read_edges([x[len(HEAD):] for x in heads], n_features), m)
        weight = pc.fill_null(table["weight"], 0.0).to_numpy()
        label = pc.fill_null(table["label"], CLASSES).to_numpy()
        crc = pc.fill_null(table["crc"], -1).to_numpy()
        scores = np.zeros((CLASSES, len(m)))
        with np.errstate(all="ignore"):
            for turn in range(int(size["rounds"].max())):
                goes = size["rounds"][m] > turn
                train = goes & (weight > 0)
                if (size["subsample"] < 1).any():
                    drawn = (crc >= 0) & (_crc_on(crc, f":{turn}".encode()) % 1000 < size["subsample"][m] * 1000)
                    train &= (size["subsample"][m] >= 1) | drawn
                e = np.exp(scores - scores.max(axis=0))
                p = e / (e[0] + e[1] + e[2])
                moved = []
                for k in range(CLASSES):
                    # multiples of 2^-20 below 2^53 of them: sums are exact
                    g = np.floor((p[k] - (label == k - 1)) * weight * SCALE + 0.5) / SCALE
                    g[label == CLASSES] = 0.0
                    h = np.floor(2.0 * p[k] * (1.0 - p[k]) * weight * SCALE + 0.5) / SCALE
                    turns = np.array(_feature_turn(turn, k, n_features))
                    taken = (size["colsample"] >= 1)[:, None] | (turns < np.ceil(size["colsample"] * n_features)[:, None])
                    value, nodes = _grow_tree(bins, m, g, h, train, size, taken)
                    moved.append(np.where(goes, size["eta"][m] * value, 0.0))
                    for owner, level, node, split, f, cut, left, right, gain in nodes:
                        n = len(owner)
                        yield out(n, model=names.take(pa.array(owner)), round=pa.array(np.full(n, turn)), level=pa.array(level), k=pa.array(np.full(n, k)),
                                  node=pa.array(node), split=pa.array(split), f=pa.array(f), bin=pa.array(cut), left=pa.array(left), right=pa.array(right), gain=pa.array(gain))
                scores += np.array(moved)
        if len(m):
            yield out(len(m), **{c: table[c].combine_chunks() for c in ("model", "id", "label", "weight")}, **{f"s{k}": pa.array(scores[k]) for k in range(CLASSES)})


def _grown(rows: DataFrame, features: Sequence[str], params: DataFrame, edges: DataFrame, drawn: bool) -> DataFrame:
    """Nodes (``round`` is not null) and scored rows of all models of ``params``, each grown in one task."""
    own = rows.select(
        "model", F.lit(1).alias("kind"), F.lit(None).cast("array<double>").alias("head"), "id", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
        (F.crc32(F.col("id").cast("string")) if drawn else F.lit(0)).cast("long").alias("crc"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    head = params.join(edges, "model").select("model", F.lit(0).alias("kind"), F.concat(_numbers(*map(F.col, HEAD)), _head(F.col("edges"))).alias("head"))
    both = head.unionByName(own, allowMissingColumns=True).repartition("model").sortWithinPartitions("model", "kind")
    kinds = dict(own.dtypes)
    tree = f"{SPLITS}, round int, level int"
    schema = f"{tree.replace('model string', 'model ' + kinds['model'])}, id {kinds['id']}, label int, weight double, s0 double, s1 double, s2 double"
    return both.mapInArrow(partial(_grow_models, n_features=len(features), together=TOGETHER), schema)


def _score_models(batches, n_features: int, together: int):
    """Scores of blocks of rows, each after its model's edges and nodes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for table, group in _whole_groups(batches, ["model", "block"], together):
        kind = table["kind"].to_numpy()
        heads, owners = _heads(table, group, kind == 0)
        if not heads:
            continue
        place = np.full(int(group[-1]) + 1, -1)
        place[owners] = np.arange(len(heads))
        at = np.flatnonzero((kind == 1) & (place[group] >= 0))
        node = pc.list_flatten(table["head"].take(at)).to_numpy().reshape(len(at), len(NODE))
        node = dict(zip(NODE, node.T)) | {"m": place[group[at]]}
        rows = np.flatnonzero((kind == 2) & (place[group] >= 0))
        m, table = place[group[rows]], table.take(rows).combine_chunks()
        if not len(rows):
            continue
        eta = np.array([x[0] for x in heads])
        bins = _bin_places(table, _read_edges([x[1:] for x in heads], n_features), m)
        scores = np.zeros((CLASSES, len(m)))
        order = np.lexsort((node["level"], node["k"], node["round"]))
        steps = np.stack([node[c][order] for c in ("round", "k", "level")])
        cuts = np.flatnonzero((steps[:, 1:] != steps[:, :-1]).any(axis=0)) + 1
        was, here, value = None, None, None
        for mine in np.split(order, cuts) if len(order) else ():
            turn, k, level = (int(node[c][mine[0]]) for c in ("round", "k", "level"))
            if was != (turn, k):
                if was:
                    scores[was[1]] += eta[m] * value
                was, here, value = (turn, k), np.ones(len(m), dtype=np.int64), np.zeros(len(m))
            entry = np.full(len(heads) << level, -1)
            entry[(node["m"][mine] << level) + node["node"][mine].astype(np.int64) - (1 << level)] = mine
            live = np.flatnonzero(here >> level == 1)
            e = entry[(m[live] << level) + here[live] - (1 << level)]
            here[live[e < 0]] = 0
            live, e = live[e >= 0], e[e >= 0]
            split = node["split"][e] > 0
            up = split & (bins[node["f"][e].astype(np.int64), live] > node["bin"][e])
            value[live] = np.where(up, node["right"][e], node["left"][e])
            here[live] = np.where(split, 2 * here[live] + up, 0)
        if was:
            scores[was[1]] += eta[m] * value
        yield pa.RecordBatch.from_arrays([table["model"].combine_chunks(), table["id"].combine_chunks(), *map(pa.array, scores)], names=["model", "id", "s0", "s1", "s2"])


# --- models -----------------------------------------------------------------------------------


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Boosted:
    """A bundle of models in one folder: ``grown`` (nodes and scored rows of models grown whole), ``trees`` (by round and
    level, of larger ones), ``edges``, ``params`` and the ordered features."""

    spark: SparkSession
    path: str
    features: list[str]
    state: str | None = None
    tables: Sequence[str] = ("trees",)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, name))

    def trees(self) -> DataFrame:
        """``model``, ``round``, ``level``, ``k``, ``node``, ``split``, ``f``, ``bin``, ``left``, ``right``, ``gain``."""
        return reduce(DataFrame.unionByName, [self._table(t).where("round IS NOT NULL").select(*_names(SPLITS), "round", "level") for t in self.tables])

    def scored_rows(self) -> DataFrame:
        """``model``, ``id``, ``label``, ``weight`` and ``probs`` of all rows given to ``fit``, those of weight 0 too."""
        found = {"grown": lambda: self._table("grown").where("round IS NULL").withColumn("scores", F.array("s0", "s1", "s2")),
                 "trees": lambda: self.spark.read.parquet(self.state)}
        parts = [found[t]().select("model", "id", "label", "weight", softmax().alias("probs")) for t in self.tables]
        return reduce(DataFrame.unionByName, parts)

    def importances(self) -> DataFrame:
        """Share of each feature in a model's gains."""
        names = F.array(*map(F.lit, self.features))
        sums = self.trees().where("split").groupBy("model", F.get(names, F.col("f")).alias("feature")).agg(F.sum("gain").alias("gain"))
        return sums.select("model", "feature", (F.col("gain") / F.sum("gain").over(Window.partitionBy("model"))).alias("importance"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``model``, ``id`` and ``probs`` of further rows (``model``, ``id`` and the features): blocks of a model's
        rows meet a copy of its trees. Rows of models that were not trained have no result."""
        own = rows.select("model", "id", *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)])
        edges = self._table("edges").join(self._table("params").select("model", "eta"), "model")
        edges = edges.select("model", F.lit(0).alias("kind"), F.concat(_numbers(F.col("eta")), _head(F.col("edges"))).alias("head"))
        heads = edges.unionByName(self.trees().select("model", F.lit(1).alias("kind"), _numbers(*map(F.col, NODE)).alias("head")))
        sizes = own.groupBy("model").agg(F.ceil(F.count("*") / SCORE_BLOCK).cast("int").alias("blocks"))
        if (sizes.agg(F.max("blocks")).first()[0] or 0) > 1:
            many = sizes.where("blocks > 1")
            own = own.join(many, "model", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
            heads = heads.join(many, "model", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        else:
            own, heads = (x.withColumn("block", F.lit(0)) for x in (own, heads))
        both = heads.unionByName(own.withColumn("kind", F.lit(2)), allowMissingColumns=True).repartition("model", "block").sortWithinPartitions("model", "block", "kind")
        kinds = dict(own.dtypes)
        schema = f"model {kinds['model']}, id {kinds['id']}, s0 double, s1 double, s2 double"
        scored = both.mapInArrow(partial(_score_models, n_features=len(self.features), together=TOGETHER), schema)
        return scored.select("model", "id", softmax(F.array("s0", "s1", "s2")).alias("probs"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted | None:
        """The bundle of a folder, None if there is none."""
        from pyspark.errors import AnalysisException

        try:
            meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return cls(spark, path, meta["feature_names"], tables=meta.get("tables", ["trees"]))


def _one_part_each(most: int, total: int, parts: int) -> bool:
    """Whether rows can be dealt by model over the parts: no model has more than a part's share."""
    return 0 < most * parts <= total


def fit(rows: DataFrame, features: Sequence[str], params: DataFrame, edges=quantile_edges, bins: int = 32,
        path: str | None = None, least_rows: int = MIN_TRAIN_ROWS) -> Boosted:
    """Train every model of ``params`` (see ``params_table``) on the rows (``model``, ``id``, ``label``, ``weight`` and
    complete features) of positive weight; rows of weight 0 are only scored. Models with fewer than ``least_rows`` such
    rows are left out (I12).

    Models of at most ``WHOLE_ROWS`` rows are grown in one job, each by one task. For larger ones there is per round one
    job a level and one that moves the scores on; scores lie in two folders written in turn. Where none of these has
    more rows than a part's share they are bucketed by model, so that rows meet their trees, and are summed
    to histograms, where they lie.
    """
    spark, features = rows.sparkSession, list(features)
    path = path or os.path.join(ensure_checkpoint_dir(spark), "boosted", uuid.uuid4().hex)

    def place(*names: str) -> str:
        return os.path.join(path, *names)

    drawn = F.col("weight") > 0
    sizes = rows.groupBy("model").agg(F.count_if(drawn).alias("n"), F.count(F.lit(1)).alias("n_all"), F.sum(F.when(drawn, F.col("weight"))).alias("heft"))
    whole = (F.col("n_all") <= WHOLE_ROWS) & (F.col("heft") < WHOLE_WEIGHT)
    params = params.join(sizes.where((F.col("n") >= least_rows) & (F.col("n") > 0)).select("model", "n", whole.alias("whole")), "model")
    params.write.parquet(place("params"))
    params = spark.read.schema(params.schema).parquet(place("params"))
    edges(rows.where(drawn), features, bins).join(params.select("model"), "model", "left_semi").write.parquet(place("edges"))
    found, large = spark.read.parquet(place("edges")), params.where("NOT whole")
    sizes = large.agg(F.max("rounds"), F.max("depth"), F.min("colsample"), F.max("n"), F.sum("n")).first()
    any_large = sizes[0] is not None
    share = params.where("whole").agg(F.min("subsample")).first()[0]
    small = rows.join(large.select("model"), "model", "left_anti") if any_large else rows
    _grown(small, features, params.where("whole"), found, (1.0 if share is None else share) < 1).write.parquet(place("grown"))
    tables, state = ["grown"], None
    if any_large:
        tables.append("trees")
        state = _by_levels(rows, features, large, found, sizes, place)
    # written last: a folder without it counts as not trained
    spark.createDataFrame([(json.dumps({"feature_names": features, "tables": tables}),)], "meta string").coalesce(1).write.text(place("meta"))
    return Boosted(spark, path, features, state, tables)


def _by_levels(rows: DataFrame, features: Sequence[str], params: DataFrame, edges: DataFrame, sizes: Sequence, place) -> str:
    """Trees of large models, level by level, below ``place("trees")``; the folder of their scored rows.
    ``sizes``: most rounds, most levels, least share of features, most and all rows of the models."""
    spark = rows.sparkSession
    start = _binned(rows, edges, features).join(params, "model")
    kept = ["model", "id", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), "bins", "rounds", "depth", "eta", "subsample", "colsample"]
    start = start.select(*kept, F.array(*[F.lit(0.0)] * CLASSES).alias("scores"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _one_part_each(sizes[3] or 0, sizes[4] or 0, parts)
    table = f"boosted_{uuid.uuid4().hex}"
    schema, state = start.schema, place("state", "start")  # the schema is known: reads look at no file

    def keep(df: DataFrame, slot: str) -> None:
        if dealt:
            df.write.mode("overwrite").bucketBy(parts, "model").option("path", place("state", slot)).saveAsTable(f"{table}_{slot}")
        else:
            df.write.mode("overwrite").parquet(place("state", slot))

    keep(start.repartition(parts, "model") if dealt else start, "start")
    for turn in range(sizes[0] or 0):
        now = spark.table(f"{table}_{os.path.basename(state)}") if dealt else spark.read.schema(schema).parquet(state)
        levels: list[str] = []

        def tree() -> DataFrame:
            return _by_model(spark.read.schema(SPLITS).parquet(*levels), len(levels))

        for level in range(sizes[1]):
            hist = _histogram(now, tree() if levels else None, turn, level, len(features), sizes[2] < 1)
            levels.append(place("trees", f"round={turn}", f"level={level}"))
            _best_splits(hist, params, level, dealt).write.parquet(levels[-1])
        moved = now.join(tree(), "model", "left")
        scores = F.array(*[F.col("scores")[k] + F.when(F.col("rounds") > turn, F.col("eta") * _walk(k, len(levels)).value).otherwise(0.0) for k in range(CLASSES)])
        state = place("state", f"slot{turn % 2}")
        keep(moved.withColumn("scores", scores).drop("tree"), os.path.basename(state))
    for slot in ("start", "slot0", "slot1") if dealt else ():
        spark.sql(f"DROP TABLE IF EXISTS {table}_{slot}")  # the files stay
    return state


# --- folds and search --------------------------------------------------------------------------


def fold_rows(rows: DataFrame, n_folds: int, keys: Sequence[str] = ("symbol", "tf"), place: str = "m") -> DataFrame:
    """Each row once per fold that trains on it (weight as it is) or tests it (weight 0), with ``fold`` from 0 on.

    By position ``place`` (dense from 0) in its series of n rows: fold i tests the n // (n_folds + 1) rows from
    n - (n_folds - i) * that on, and trains on all rows before.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    rows = rows.join(sizes, list(keys))
    size = F.floor(F.col("n_") / (n_folds + 1)).cast("long")
    folds = F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: F.struct(i.alias("fold"), (F.col("n_") - (F.lit(n_folds) - i) * size).alias("from_")))
    out = rows.withColumn("size_", size).withColumn("f_", F.explode(folds))
    at, start = F.col(place), F.col("f_.from_")
    out = out.where(at < start + F.col("size_")).withColumn("fold", F.col("f_.fold"))
    return out.withColumn("weight", F.when(at < start, F.col("weight")).otherwise(F.lit(0.0))).drop("n_", "size_", "f_")


def draws(grid: dict[str, Sequence], n: int, seed: int = 42) -> list[BoostParams]:
    """``n`` different points of a grid of ``BoostParams`` fields (all, if it has fewer), in the order drawn."""
    import random

    total = math.prod(len(v) for v in grid.values())
    out = []
    for at in random.Random(seed).sample(range(total), min(n, total)):
        choice = {}
        for name, values in grid.items():
            at, k = divmod(at, len(values))
            choice[name] = values[k]
        out.append(BoostParams(**choice))
    return out


def search(rows: DataFrame, features: Sequence[str], candidates: Sequence[BoostParams], n_folds: int,
           keys: Sequence[str] = ("symbol", "tf"), edges=quantile_edges, bins: int = 32, least_rows: int = MIN_TRAIN_ROWS) -> DataFrame:
    """Macro-F1 of every candidate on every fold of every series: ``symbol``, ``tf``, ``draw``, ``fold``, ``macro_f1``,
    and the mean over the folds as ``score``. All candidates and folds are models of one fit.

    ``rows`` have the keys, the position ``m``, ``id``, ``label``, ``weight`` and the features.
    """
    from ..functions.scalar import argmax_class
    from .metrics import classification_report

    spark = rows.sparkSession
    folds = fold_rows(rows, n_folds, keys)
    name = F.concat_ws("|", *keys, F.col("fold").cast("string"))
    folds = folds.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(len(candidates) - 1))))
    folds = folds.withColumn("model", F.concat_ws("|", name, F.col("draw").cast("string")))
    table = params_table(spark, {str(i): p for i, p in enumerate(candidates)}).withColumnRenamed("model", "draw_")
    models = folds.select("model", F.col("draw").cast("string").alias("draw_")).distinct().join(table, "draw_").drop("draw_")
    fitted = fit(folds.select("model", "id", "label", "weight", *features), features, models, edges, bins, least_rows=least_rows)
    tested = fitted.scored_rows().where("weight = 0").withColumn("pred", argmax_class("probs"))
    report = classification_report(tested, "label", "pred", keys=("model",))
    report = report.select(F.split("model", r"\|").alias("p_"), "macro_f1").select(
        *[F.get("p_", F.lit(i)).alias(k) for i, k in enumerate(keys)], F.get("p_", F.lit(len(keys) + 1)).cast("int").alias("draw"), F.get("p_", F.lit(len(keys))).cast("int").alias("fold"), "macro_f1")
    return report.withColumn("score", F.avg("macro_f1").over(Window.partitionBy(*keys, "draw")))


def best_draws(scores: DataFrame, keys: Sequence[str] = ("symbol", "tf")) -> DataFrame:
    """Per series the draw of the highest score, the first if equal."""
    one = scores.select(*keys, "draw", "score").distinct()
    return one.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("draw")).alias("d"))).alias("b")).select(*keys, (-F.col("b.d")).alias("draw"), F.col("b.score").alias("score"))
