"""Quality rules: boosted trees over document statistics, after two plain rules.

The trees are fitted on a bounded labelled sample (``docstats.MAX_LABELLED``) by histograms
of the logistic loss, with monotonic constraints: more symbols, repeats, capitals or
shouting never raise a score. All trees lie in flat numpy arrays (feature, threshold, left,
right, value), so a block of rows walks down all trees at once, level by level.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows get
equal verdicts; without labels of both kinds the trees are empty and only the base rules
decide; an empty table gives an empty table; ``judge`` doesn't read further columns, ``keep``
passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import map_documents, release_memory
from candlewick.llm.docstats import COUNTS, FEATURES, MAX_LABELLED, Statistics, labelled

#: Features that may only lower a score as they grow.
FALLING = ("symbols", "dup_lines", "repeat_words", "upper", "shouts", "pipes")


@dataclass
class Forest:
    """Trees as node arrays; ``roots`` has each tree's first node, leaves point at themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boosted trees on quantile bins. ``sign``: -1 where a feature may only lower the score, 1 raise, 0 free."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def add(value: float) -> int:
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    def done(base: float, roots: list[int]) -> Forest:
        if not roots:
            roots = [add(0.0)]
        a = {k: np.array(v) for k, v in nodes.items()}
        return Forest(base, np.array(roots), **a, depth=depth)

    n, width = x.shape
    share = y.mean() if n else 1.0
    if share in (0.0, 1.0):
        return done(20.0 if share else -20.0, [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    base = float(np.log(share / (1 - share)))
    raw, roots = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        where = np.zeros(n, dtype=np.int64)  # position among the level's open nodes, -1: in a leaf
        level = [(root, -np.inf, np.inf)]
        final = np.full(n, root)
        for _ in range(depth):
            inside = np.flatnonzero(where >= 0)
            if not len(inside) or not level:
                break
            key = (where[inside, None] * (width * bins) + flat[inside]).ravel()
            size = len(level) * width * bins
            g = np.bincount(key, np.repeat(grad[inside], width), size).reshape(len(level), width, bins).cumsum(axis=2)
            h = np.bincount(key, np.repeat(hess[inside], width), size).reshape(len(level), width, bins).cumsum(axis=2)
            total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
            low = np.array([a for _, a, _ in level])[:, None, None]
            high = np.array([b for _, _, b in level])[:, None, None]
            left_v = np.clip(g / (h + ridge), low, high)
            right_v = np.clip((total_g - g) / (total_h - h + ridge), low, high)
            gain = left_v * g - 0.5 * left_v**2 * (h + ridge) + right_v * (total_g - g) - 0.5 * right_v**2 * (total_h - h + ridge)
            whole = np.clip(total_g / (total_h + ridge), low, high)
            gain = gain - (whole * total_g - 0.5 * whole**2 * (total_h + ridge))
            bad = (h < least) | (total_h - h < least) | (sign[None, :, None] * (right_v - left_v) < 0)
            gain[bad] = 0
            best = gain.reshape(len(level), -1).argmax(axis=1)
            following, moved = [], np.full(n, -1)
            for k, (node, a, b) in enumerate(level):
                f, cut = divmod(int(best[k]), bins)
                members = inside[where[inside] == k]
                if gain[k, f, cut] <= 1e-9 or cut >= len(edges[f]):
                    continue
                lv, rv = float(left_v[k, f, cut]), float(right_v[k, f, cut])
                i, j = add(lv), add(rv)
                nodes["feature"][node], nodes["threshold"][node] = f, float(edges[f][cut])
                nodes["left"][node], nodes["right"][node] = i, j
                goes_left = binned[members, f] <= cut
                final[members] = np.where(goes_left, i, j)
                middle = (lv + rv) / 2
                bounds = {0: ((a, b), (a, b)), -1: ((middle, b), (a, middle)), 1: ((a, middle), (middle, b))}[int(sign[f])]
                moved[members] = np.where(goes_left, len(following), len(following) + 1)
                following += [(i, *bounds[0]), (j, *bounds[1])]
            level, where = following, moved
        for node in range(root, len(nodes["value"])):
            nodes["value"][node] *= rate
        raw += np.array(nodes["value"])[final]
    return done(base, roots)


def signs(falling: tuple[str, ...] = FALLING) -> np.ndarray:
    return np.array([-1 if f in falling else 0 for f in FEATURES])


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


class Rules:
    """Texts to counts, base_failed, score and kept, a block at a time."""

    def __init__(self, forest: Forest, threshold: float = 0.5):
        self.forest, self.threshold, self.of = forest, threshold, Statistics()

    def __call__(self, texts: list) -> dict:
        both = [self.of(t) for t in texts]
        counts = np.array([b[0] for b in both], dtype=np.int64).reshape(len(both), len(COUNTS))
        out = {c: counts[:, i] for i, c in enumerate(COUNTS)}
        score = self.forest.score(np.array([b[1] for b in both], dtype=float).reshape(len(both), len(FEATURES)))
        failed = base_failed(out["n_words"], out["n_repeat_words"])
        return out | {"base_failed": failed, "score": score, "kept": ~failed & (score >= self.threshold)}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = MAX_LABELLED) -> Forest:
    return fit_forest(*labelled(docs, labels, text=text, limit=limit), signs())


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the five counts, base_failed, score and kept for every document, in one pass."""
    forest = fit(docs, labels, text, limit)

    def factory():
        rules = Rules(forest, threshold)

        def apply(doc_id, texts):
            return {"doc_id": doc_id} | rules(texts)

        return apply

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return map_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), schema, factory)


def keep(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    forest, at = fit(docs, labels, text, limit), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(forest, threshold)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(rules(part.column(at).to_pylist())["kept"]))
        batch = part = None
        release_memory()

    return docs.mapInArrow(run, docs.schema)
