"""Small learners in numpy for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the intercept comes last and is not shrunk."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(shrink), a.T @ (p - y) + shrink * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty * |w|_1, by accelerated proximal steps."""
    n, m = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / n * 1.05)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        new = z - step * (a.T @ (sigmoid(a @ z) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


Rule = tuple[tuple[int, bool, float], ...]


def _grow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, leaf: np.ndarray, cuts: list[np.ndarray], least: int) -> None:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(bins.shape[1]):
            k = len(cuts[f]) + 1
            if k < 2:
                continue
            b = bins[rows, f]
            gl = np.cumsum(np.bincount(b, grad[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], k))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=k))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (f, i))
    if best[1] is None:
        leaf[rows] = -g / (h + 1)
        return
    f, i = best[1]
    low = bins[rows, f] <= i
    for side, part in ((True, rows[low]), (False, rows[~low])):
        step = (*path, (f, side, float(cuts[f][i])))
        out.append(step)
        _grow(bins, grad, hess, part, depth - 1, step, out, leaf, cuts, least)


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """Every path of a boosted tree ensemble as a conjunction of (column, at most?, threshold)."""
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 64)))
        cuts.append((q[:-1] + q[1:]) / 2)
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    z, rules, least = np.zeros(len(x)), [], max(3, len(x) // 1000)
    for _ in range(trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(x)) < 0.7)
        if len(rows) < 2 * least:
            rows = np.arange(len(x))
        leaf, out = np.zeros(len(x)), []
        _grow(bins, p - y, p * (1 - p) + 1e-6, rows, depth, (), out, leaf, cuts, least)
        rules += out
        # rows outside the draw follow the tree as well
        for path in out:
            if path not in [o[: len(path)] for o in out if len(o) > len(path)]:
                hit = apply_rule(path, x)
                inside = hit[rows]
                z[hit] += rate * (leaf[rows][inside].mean() if inside.any() else 0.0)
    return list(dict.fromkeys(rules))


def apply_rule(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, low, cut in rule:
        hit &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return hit
