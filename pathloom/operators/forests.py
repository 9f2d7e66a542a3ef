"""Conformal forests on the pixels of one region, small enough to be fitted anew at each step of a propagation.

``cascade`` fits forests over tables with Spark's learners. A followed line needs a field at every step, made from a few thousand pixels
around the line of the step before, so here a layer of forests is a handful of arrays in the task that follows the line. All
trees of a forest grow level by level side by side. Layers and recordings run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pathloom.operators.conformal import EPSILON, LAMBDA, THETA

#: Rows times tries that are worked at a time.
TOGETHER = 60000
#: Random draws of the forests of a layer: whether rows are resampled, and the cuts tried for each feature.
FORESTS = ((10, True, 4), (20, True, 4), (30, False, 1), (44, False, 1))
@dataclass
class Forest:
    """Heap-ordered nodes of each tree: the feature and cut of inner nodes, the share of label 1 in the last level's."""

    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray

    def last(self, x: np.ndarray) -> np.ndarray:
        """Each row's node on the last level of each tree."""
        (trees, inner), (n, width) = self.cut.shape, x.shape
        first, row = np.arange(trees)[:, None] * inner, np.arange(n)[None] * width
        if not inner:
            return np.zeros((trees, n), np.int64)
        node = 1 + (x.take(self.feature[:, 0], 1) > self.cut[:, 0]).T  # all rows are at the root
        x, feature, cut = x.ravel(), self.feature.ravel(), self.cut.ravel()
        for _ in range(int(np.log2(inner + 1)) - 1):
            at = first + node
            node = 2 * node + 1 + (x.take(row + feature.take(at)) > cut.take(at))
        return node - inner

    def p1(self, x: np.ndarray) -> np.ndarray:
        return self.share[np.arange(len(self.cut))[:, None], self.last(x)].mean(0)

    def renewed(self, young: "Forest", x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Forest":
        """As many trees as before, ``young``'s and the youngest of these; the shares of those that stay are those of the rows given, where any come to a node."""
        old = Forest(*(a[: len(a) - len(young.cut)] for a in (self.feature, self.cut, self.share)))
        trees, m = old.share.shape
        key = (np.arange(trees)[:, None] * m + old.last(x)).ravel()
        all_, ones = (np.bincount(key, np.tile(v, trees), trees * m).reshape(trees, m) for v in (weight, weight * y))
        old.share = np.where(all_ > 0, ones / np.maximum(all_, 1e-12), old.share)
        return Forest(*(np.concatenate(p) for p in ((young.feature, old.feature), (young.cut, old.cut), (young.share, old.share))))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, depth: int, seed: int, resample: bool, cuts: int) -> Forest:
    """Trees of ``depth`` levels. Each node tries sqrt(features) random features with ``cuts`` random cuts each, drawn between
    two of its rows, and takes the one of least impurity. With one cut and all rows these are extremely randomised trees."""
    rng, (n, width) = np.random.default_rng(seed), x.shape
    w = (rng.multinomial(n, np.full(n, 1 / n), trees) if resample else np.ones((trees, n))) * weight
    inner, rows, ones_w = 2**depth - 1, np.arange(n)[None], (w * y).ravel()
    flat, row, own_w = np.ascontiguousarray(x).ravel(), np.tile(np.arange(n) * width, trees), w.ravel()
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    node, share = np.zeros((trees, n), np.int64), np.full((trees, 1), (weight * y).sum() / weight.sum())
    for level in range(depth + 1):
        m, first = 2**level, 2**level - 1
        key = (np.arange(trees)[:, None] * m + node - first).ravel()
        add = lambda v: np.bincount(key, v.ravel(), trees * m)
        all_, ones = add(w), add(w * y)
        above = np.repeat(share, 2, 1) if level else share
        share = np.where(all_ > 0, ones / np.maximum(all_, 1e-12), above.ravel()).reshape(trees, m)
        if level == depth:
            return Forest(feature, cut, share)
        order = np.argsort(key + rng.random(key.size)) % n
        held = np.bincount(key, minlength=trees * m)
        start, tries = np.cumsum(held) - held, max(1, int(width**0.5)) * cuts
        f, r = np.empty((tries, trees * m), np.int64), np.empty((tries, 3, trees * m))  # drawn try by try, worked together
        for k in range(tries):
            f[k], r[k] = rng.integers(0, width, trees * m), rng.random((3, trees * m))
        a, b = (x[order[np.minimum(start + (r[:, k] * held).astype(np.int64), key.size - 1)], f] for k in (0, 1))
        c, pure = a + r[:, 2] * (b - a), np.full((tries, trees * m), -1.0)
        # rows by node: a node's sums are those of a run, and its feature and cut are repeated over it
        by_node, full = np.argsort(key.astype(np.int16) if trees * m < 1 << 15 else key, kind="stable"), np.flatnonzero(held)
        run, size, base, w_of, ones_of = start[full], held[full], row[by_node], own_w[by_node], ones_w[by_node]
        qa, pa = np.add.reduceat(w_of, run), np.add.reduceat(ones_of, run)
        for at in range(0, tries, together := max(1, TOGETHER // key.size)):
            own = slice(at, at + together)
            left = (flat.take(base + f[own, full].repeat(size, 1)) <= c[own, full].repeat(size, 1)).astype(float)
            lw, l1 = (np.add.reduceat(left * v, run, 1) for v in (w_of, ones_of))
            value = sum((p * p + (q - p) ** 2) / np.maximum(q, 1e-12) for p, q in ((l1, lw), (pa - l1, qa - lw)))
            pure[own, full] = np.where((lw > 0) & (lw < qa) & (size > 1), value, -1.0)
        first_best, node_of = pure.argmax(0), np.arange(trees * m)
        found = pure[first_best, node_of] > -1.0
        best_feature, best_cut = np.where(found, f[first_best, node_of], 0), np.where(found, c[first_best, node_of], np.inf)
        feature[:, first : first + m], cut[:, first : first + m] = best_feature.reshape(trees, m), best_cut.reshape(trees, m)
        own = np.arange(trees)[:, None]
        node = 2 * node + 1 + (x[rows, feature[own, node]] > cut[own, node])
    raise AssertionError


def split(y: np.ndarray, shares: tuple[float, ...], rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of each part: every label's rows in random order, cut at the cumulative shares."""
    parts: list[list[np.ndarray]] = [[] for _ in shares]
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        for part, rows in zip(parts, np.split(own, np.floor(np.cumsum(shares[:-1]) * len(own) + 1e-9).astype(int))):
            part.append(rows)
    return [np.concatenate(p) for p in parts]


def p_values(score: np.ndarray, calibration: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """(less + tau * equal) / (n + 1) among sorted calibration scores; 0 without any."""
    low, high = np.searchsorted(calibration, score, "left"), np.searchsorted(calibration, score, "right")
    return (low + tau * (high - low)) / (len(calibration) + 1.0) if len(calibration) else np.zeros(len(score))


class Layer:
    """Four forests, their calibration scores, and each class's filtered outputs and forest weights.

    With the same layer of the step ``before``, only the share ``fresh`` of the trees is grown, and takes the place of the oldest.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, rng: np.random.Generator, before: "Layer | None" = None, fresh: float = 1.0):
        own = np.concatenate([np.arange(len(y)), *(np.resize(np.flatnonzero(y == k), max(0, 5 - (y == k).sum())) for k in (0, 1) if (y == k).any())])
        x, y = x[own], y[own]
        train, calibrate, judge = split(y, (0.8, 0.1, 0.1), rng)
        count = np.bincount(y[train], minlength=2)
        weight = (len(train) / (2.0 * np.maximum(count, 1)))[y[train]]
        self.turn = before.turn + 1 if before else 0
        new = trees if before is None else min(trees, max(1, round(trees * fresh)))
        self.forests = [grow(x[train], y[train], weight, new, depth, seed + 100 * self.turn, *more) for seed, *more in FORESTS]
        if before is not None and new < trees:
            self.forests = [old.renewed(young, x[train], y[train], weight) for old, young in zip(before.forests, self.forests)]
        cal = self.scores(x[calibrate])
        self.calibration = [[np.sort(cal[t, y[calibrate] == k, k]) for k in (0, 1)] for t in range(len(self.forests))]
        u = np.ones((len(self.forests), 2))
        inside = self.p(x[judge], rng) > EPSILON
        for t in range(len(self.forests)):
            size = inside[t].sum(1)
            for k in (0, 1):
                rho = np.where(size > 0, size - inside[t, :, k], 1)[y[judge] == k]
                psi = inside[t, y[judge] != k, k]
                u[t, k] = LAMBDA * (rho.mean() if len(rho) else 1.0) + (1 - LAMBDA) * (psi.mean() if len(psi) else 1.0)
        norm, n = u / (u.sum(0) + 1e-8), len(self.forests)
        q = min(np.ceil((n + 1) * THETA) / n, 1.0)
        self.filtered = norm > np.sort(norm, 0)[int(np.floor(q * (n - 1)))]
        raw = np.maximum(0, (1 - u) / (1 + u + 1e-8))
        self.weight = np.where(raw.sum(0) > 0, raw / np.maximum(raw.sum(0), 1e-12), 1 / n)

    def proba(self, x: np.ndarray) -> np.ndarray:
        """(forests, rows, classes)."""
        one = np.stack([f.p1(x) for f in self.forests])
        return np.stack([1 - one, one], 2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = self.proba(x)
        return (1 + p - p[:, :, ::-1]) / 2

    def p(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        s = self.scores(x)
        return np.stack([np.stack([p_values(s[t, :, k], self.calibration[t][k], rng.random(len(x))) for k in (0, 1)], 1) for t in range(len(s))])

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.filtered[:, None], 0, self.proba(x)).transpose(1, 0, 2).reshape(len(x), -1)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    pos, neg = score[y == 1], np.sort(score[y == 0])
    if not len(pos) or not len(neg):
        return 0.5
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).mean() / 2 / len(neg))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, more_trees: int = 20, layers: int = 5, depth: int = 7, seed: int = 7, before: list[Layer] | None = None, fresh: float = 1.0) -> list[Layer]:
    """Layers on features and the outputs of the layer before; one that doesn't raise the AUC on a fifth of the rows is the last. None
    with one label. Each layer goes on from that of the step ``before``, as ``Layer`` says."""
    if len(np.unique(y)) < 2:
        return []
    rng = np.random.default_rng(seed)
    own, judge = split(y, (0.8, 0.2), rng)
    out, best, a, b = [], -1.0, x[own], x[judge]
    for k in range(layers):
        layer = Layer(a, y[own], trees if k == 0 else more_trees, depth, rng, before[k] if before and k < len(before) and fresh < 1 else None, fresh)
        out.append(layer)
        area = auc(layer.weight[:, 1] @ layer.proba(b)[:, :, 1], y[judge])
        if area <= best:
            break
        best = area
        a, b = np.hstack([x[own], layer.outputs(a)]), np.hstack([x[judge], layer.outputs(b)])
    return out


def field(layers: list[Layer], x: np.ndarray, seed: int = 42) -> np.ndarray:
    """The last layer's p-values of class 1, weighted over the forests, lowered outside the prediction set, and scaled to 1."""
    own = x
    for layer in layers[:-1]:
        own = np.hstack([x, layer.outputs(own)])
    p = np.tensordot(layers[-1].weight[:, 1], layers[-1].p(own, np.random.default_rng(seed))[:, :, 1], 1)
    p = p * np.where(p > EPSILON, 1.0, 0.7)
    return p / p.max() if p.max() > 0 else p
