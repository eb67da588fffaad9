"""Softmax boosting in plain numpy: every histogram, split and leaf written out."""

import zlib

import numpy as np

SCALE = float(1 << 20)


def softmax(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / (e[:, 0] + e[:, 1] + e[:, 2])[:, None]


def binned(x, edges):
    return np.stack([(np.asarray(e)[None, :] < x[:, [i]]).sum(axis=1) for i, e in enumerate(edges)], axis=1)


def plain_fit(ids, bins, label, weight, p):
    """(trees, probabilities): trees as {(round, class, node): (split, feature, bin, left, right)}."""
    n, d = bins.shape
    scores, trees = np.zeros((n, 3)), {}
    for turn in range(p.rounds):
        prob, drawn = softmax(scores), weight > 0
        if p.subsample < 1:
            drawn &= np.array([zlib.crc32(f"{i}:{turn}".encode()) % 1000 < p.subsample * 1000 for i in ids])
        moves = np.zeros((n, 3))
        for k in range(3):
            order = sorted(range(d), key=lambda f: (zlib.crc32(f"{turn}:{k}:{f}".encode()), f))
            allowed = sorted(order[: int(np.ceil(p.colsample * d))]) if p.colsample < 1 else list(range(d))
            g = np.floor((prob[:, k] - (label == k - 1)) * weight * SCALE + 0.5).astype(np.int64)
            h = np.floor(2.0 * prob[:, k] * (1.0 - prob[:, k]) * weight * SCALE + 0.5).astype(np.int64)
            node, value, live = np.ones(n, dtype=int), np.zeros(n), np.ones(n, dtype=bool)
            for level in range(p.depth):
                for nd in sorted(set(node[live & drawn])):
                    rows = np.flatnonzero(drawn & live & (node == nd))
                    tg, th = g[rows].sum() / SCALE, h[rows].sum() / SCALE
                    best = (0.0, 0, 0, 0.0, 0.0)
                    for f in allowed:
                        for b in range(int(bins[rows, f].max())):
                            left = rows[bins[rows, f] <= b]
                            gl, hl = g[left].sum() / SCALE, h[left].sum() / SCALE
                            gr, hr = (g[rows].sum() - g[left].sum()) / SCALE, (h[rows].sum() - h[left].sum()) / SCALE
                            if len(left) == 0 or hl < p.min_child or hr < p.min_child:
                                continue
                            gain = gl * gl / (hl + p.lam) + gr * gr / (hr + p.lam) - tg * tg / (th + p.lam)
                            if gain > 1e-9 and gain > best[0]:
                                best = (gain, f, b, -gl / (hl + p.lam), -gr / (hr + p.lam))
                    everyone = np.flatnonzero(live & (node == nd))
                    if best[0] > 0:
                        up = bins[everyone, best[1]] > best[2]
                        value[everyone], node[everyone] = np.where(up, best[4], best[3]), 2 * nd + up
                        trees[turn, k, nd] = (True, *best[1:])
                    else:
                        if level == 0:
                            value[everyone] = -tg / (th + p.lam)
                            trees[turn, k, nd] = (False, None, None, value[everyone][0], None)
                        live[everyone] = False
                live &= node >= 1 << (level + 1)
            moves[:, k] = value
        scores = scores + p.eta * moves
    return trees, softmax(scores)


def macro_f1(label, pred):
    out = []
    for c in (-1, 0, 1):
        tp = int(((label == c) & (pred == c)).sum())
        prec = tp / max(1, int((pred == c).sum()))
        rec = tp / max(1, int((label == c).sum()))
        out.append(2.0 * prec * rec / (prec + rec) if prec + rec else 0.0)
    return sum(out) / 3.0
