"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its quantile bins. The tables grow by cyclic
boosting: one shallow tree on one feature at a time, with a small step, so features share
the credit. Then the pairs whose coarse grids explain most of what is left get tables of
their own, grown in the same way by quadrant trees. A score is the logistic of the sum of
a row's table entries: vectorised additions by bin, no trees are kept.

It is fitted on a bounded labelled sample (``docstats.MAX_LABELLED``) of rows that are not
held out. Labels, language, source and ids are never inputs of a score.

Edge cases: null and empty texts have all features zero and get the score of those bins;
repeated rows get equal scores; with labels of one kind only the score is that kind's
share; without labels it is 0.5; an empty table gives an empty table; further columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import map_documents
from candlewick.llm.docstats import FEATURES, MAX_LABELLED, Statistics, held_out, labelled


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f])]
        for (a, b), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[a], x[:, a]), np.searchsorted(self.coarse[b], x[:, b])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values per bin of a tree that splits the best leaf until there are ``leaves``."""
    parts = [(0, len(g))]

    def best(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = g[lo:hi].cumsum(), h[lo:hi].cumsum()
        gr, hr = gl[-1] - gl, hl[-1] - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[-1] ** 2 / (hl[-1] + ridge)
        gain[(hl < least) | (hr < least)] = 0
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    found = {parts[0]: best(*parts[0])}
    while len(parts) < leaves:
        part = max(parts, key=lambda p: found[p][0])
        gain, cut = found[part]
        if gain <= 1e-9 or not part[0] < cut < part[1]:
            break
        parts.remove(part)
        for p in ((part[0], cut), (cut, part[1])):
            parts.append(p)
            found[p] = best(*p)
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, float]:
    """Values per cell of the best cut on both axes, and its gain."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total_g, total_h = gc[-1, -1], hc[-1, -1]
    row_g, row_h = gc[:-1, -1:], hc[:-1, -1:]
    col_g, col_h = gc[-1:, :-1], hc[-1:, :-1]
    a, ah = gc[:-1, :-1], hc[:-1, :-1]
    cells = [(a, ah), (row_g - a, row_h - ah), (col_g - a, col_h - ah), (total_g - row_g - col_g + a, total_h - row_h - col_h + ah)]
    if not a.size:
        return np.zeros_like(g), 0.0
    gain = sum(np.where(w < least, 0, v**2 / (w + ridge)) for v, w in cells)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for (v, w), rows, cols in zip(cells, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2):
        if w[i, j] >= least:
            out[rows, cols] = v[i, j] / (w[i, j] + ridge)
    return out, float(gain[i, j] - total_g**2 / (total_h + ridge))


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, bins: int = 64, leaves: int = 3, rate: float = 0.1, pairs: int = 6, pair_rounds: int = 60, pair_bins: int = 16, ridge: float = 1.0, least: float = 5.0) -> Additive:
    n, width = x.shape
    if not n:
        return Additive(0.0, [np.array([])] * width, [np.zeros(1)] * width)
    edges = _quantiles(x, bins)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Additive(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if y.min() == y.max():
        return model
    binned = [np.searchsorted(edges[f], x[:, f]) for f in range(width)]
    raw = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            size = len(edges[f]) + 1
            if size == 1:
                continue
            grad, hess = slopes()
            step = rate * _shallow(np.bincount(binned[f], grad, size), np.bincount(binned[f], hess, size), leaves, ridge, least)
            model.tables[f] += step
            raw += step[binned[f]]
    model.coarse = _quantiles(x, pair_bins)
    coarse = [np.searchsorted(model.coarse[f], x[:, f]) for f in range(width)]
    shape = [len(c) + 1 for c in model.coarse]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grad, hess = slopes()
        key, size = coarse[a] * shape[b] + coarse[b], shape[a] * shape[b]
        return key, np.bincount(key, grad, size).reshape(shape[a], shape[b]), np.bincount(key, hess, size).reshape(shape[a], shape[b])

    gains = {(a, b): _quadrants(*grid(a, b)[1:], ridge, least)[1] for a, b in combinations(range(width), 2) if shape[a] > 1 < shape[b]}
    for a, b in sorted(gains, key=lambda p: (-gains[p], p))[:pairs]:
        model.pairs[a, b] = np.zeros((shape[a], shape[b]))
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            key, g, h = grid(a, b)
            step = rate * _quadrants(g, h, ridge, least)[0]
            table += step
            raw += step.ravel()[key]
    return model


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every document, in one pass."""
    model = fit_additive(*labelled(docs, labels, label, text, limit))

    def factory():
        of = Statistics()

        def apply(doc_id, texts):
            x = np.array([of(t)[1] for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            return {"doc_id": doc_id, "score": model.score(x)}

        return apply

    scored = map_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), "doc_id long, score double", factory)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
