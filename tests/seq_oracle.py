"""Sequential single-series indicator loops (test oracle only, plain Python)."""

from __future__ import annotations

import math

ZERO = 1e-14


def ema(x, p, start=0):
    out = [None] * len(x)
    a = 2.0 / (p + 1)
    if len(x) < start + p:
        return out
    y = sum(x[start:start + p]) / p
    out[start + p - 1] = y
    for t in range(start + p, len(x)):
        y = a * x[t] + (1 - a) * y
        out[t] = y
    return out


def sma(x, p):
    out = [None] * len(x)
    for t in range(p - 1, len(x)):
        win = x[t - p + 1:t + 1]
        if any(v is None for v in win):
            continue
        out[t] = sum(win) / p
    return out


def wilder(x, p, start):
    """x valid from ``start``; seed = mean of p values; then (y*(p-1)+x)/p."""
    out = [None] * len(x)
    if len(x) < start + p:
        return out
    y = sum(x[start:start + p]) / p
    out[start + p - 1] = y
    for t in range(start + p, len(x)):
        y = (y * (p - 1) + x[t]) / p
        out[t] = y
    return out


def true_range(h, l, c):
    tr = [None]
    for t in range(1, len(c)):
        tr.append(max(h[t] - l[t], abs(h[t] - c[t - 1]), abs(l[t] - c[t - 1])))
    return tr


def atr(h, l, c, p=14):
    return wilder(true_range(h, l, c), p, 1)


def rsi(c, p=14):
    gains = [None] + [max(c[t] - c[t - 1], 0.0) for t in range(1, len(c))]
    losses = [None] + [max(c[t - 1] - c[t], 0.0) for t in range(1, len(c))]
    g, l = wilder(gains, p, 1), wilder(losses, p, 1)
    out = [None] * len(c)
    for t in range(len(c)):
        if g[t] is None:
            continue
        s = g[t] + l[t]
        out[t] = 0.0 if abs(s) < ZERO else 100.0 * g[t] / s
    return out


def macd(c, fast=12, slow=26, sig=9):
    f = ema(c, fast, start=slow - fast)
    s = ema(c, slow)
    line = [None if (a is None or b is None) else a - b for a, b in zip(f, s)]
    signal = ema([0.0 if v is None else v for v in line], sig, start=slow - 1)
    first = slow + sig - 2
    m = [line[t] if t >= first else None for t in range(len(c))]
    sg = [signal[t] if t >= first else None for t in range(len(c))]
    hist = [None if a is None else a - b for a, b in zip(m, sg)]
    return m, sg, hist


def adx(h, l, c, p=14):
    n = len(c)
    out = [None] * n
    if n < 2 * p:
        return out
    pdm = mdm = tr = 0.0
    for t in range(1, p):
        up, dn = h[t] - h[t - 1], l[t - 1] - l[t]
        if dn > 0 and up < dn:
            mdm += dn
        elif up > 0 and up > dn:
            pdm += up
        tr += max(h[t] - l[t], abs(h[t] - c[t - 1]), abs(l[t] - c[t - 1]))

    def step(t, pdm, mdm, tr):
        up, dn = h[t] - h[t - 1], l[t - 1] - l[t]
        pd = up if (up > 0 and up > dn) else 0.0
        md = dn if (dn > 0 and up < dn) else 0.0
        trv = max(h[t] - l[t], abs(h[t] - c[t - 1]), abs(l[t] - c[t - 1]))
        return pdm - pdm / p + pd, mdm - mdm / p + md, tr - tr / p + trv

    def dx(pdm, mdm, tr):
        if abs(tr) < ZERO:
            return None
        pdi, mdi = 100 * pdm / tr, 100 * mdm / tr
        s = pdi + mdi
        if abs(s) < ZERO:
            return None
        return 100 * abs(pdi - mdi) / s

    total = 0.0
    t = p
    for t in range(p, 2 * p):
        pdm, mdm, tr = step(t, pdm, mdm, tr)
        d = dx(pdm, mdm, tr)
        if d is not None:
            total += d
    a = total / p
    out[2 * p - 1] = a
    for t in range(2 * p, n):
        pdm, mdm, tr = step(t, pdm, mdm, tr)
        d = dx(pdm, mdm, tr)
        if d is not None:
            a = (a * (p - 1) + d) / p
        out[t] = a
    return out


def close(a, b, rel=1e-9, abs_=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=rel, abs_tol=abs_)
