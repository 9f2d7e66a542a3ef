"""Extremely randomised trees over tables of any size, all trees of all forests grown level by level.

Every node tries a few random features with one random cut each, drawn between the bounds that the cuts above it leave. The draws need no data, so a
level is one pass: each task sends its rows down the trees grown so far and counts, for each tree, node and try, the rows of each label
below the cut. Tasks hand on these counts only, and the driver, which picks each node's best cut, gets trees x nodes x tries numbers, whatever the input.
Counts are whole numbers, so the trees don't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.forests import Forest

#: Rows that a task counts at a time.
ROWS = 4096


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column of fixed length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def bounds(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature's least and greatest value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            x = matrix_of(b.column(0), width)
            low, high = np.minimum(low, x.min(0, initial=np.inf)), np.maximum(high, x.max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    ends = df.select("features").mapInArrow(run, "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").toArrow()
    some = np.isfinite(ends["low"].to_numpy())  # no row, no bounds
    return np.where(some, ends["low"].to_numpy(), 0.0), np.where(some, ends["high"].to_numpy(), 0.0)


def draws(rngs: list[np.random.Generator], trees: int, low: np.ndarray, high: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and cuts (trees of all forests, nodes, tries) for nodes with bounds (trees, nodes, features)."""
    nodes, width = low.shape[1:]
    f = np.concatenate([rng.integers(0, width, (trees, nodes, tries)) for rng in rngs])
    share = np.concatenate([rng.random((trees, nodes, tries)) for rng in rngs])
    a, b = np.take_along_axis(low, f, 2), np.take_along_axis(high, f, 2)
    return f, a + share * (b - a)


def down(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Each row's node, counted within its level, after ``levels`` levels of each tree."""
    trees, rows = np.arange(len(cut))[:, None], np.arange(len(x))[None]
    node = np.zeros((len(cut), len(x)), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[rows, feature[trees, node]] > cut[trees, node])
    return node - (2**levels - 1)


def count(df: DataFrame, width: int, feature: np.ndarray, cut: np.ndarray, level: int, f: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(trees, nodes of the level, tries + 1, labels): rows below each try's cut, and all rows last."""
    trees, nodes, tries = f.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((tries + 1, trees * nodes * 2), np.int64), np.arange(trees)[:, None]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, y = matrix_of(part.column(0), width), part.column(1).to_numpy()
                node, rows = down(x, feature, cut, level), np.arange(len(x))[None]
                key = (own * nodes + node) * 2 + y
                for k in range(tries):
                    below = x[rows, f[own, node, k]] <= c[own, node, k]
                    total[k] += np.bincount(key[below], minlength=trees * nodes * 2)
                total[tries] += np.bincount(key.ravel(), minlength=trees * nodes * 2)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "n"])

    found = df.select("features", F.col("label").cast("int")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((tries + 1) * trees * nodes * 2, np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(tries + 1, trees, nodes, 2).transpose(1, 2, 0, 3)


def best_cuts(counts: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """The try of least weighted impurity of each node, the first of those equal in nine digits; -1 where none parts its rows."""
    left, every = counts[:, :, :-1], counts[:, :, -1:]
    pure = sum(((side * weights) ** 2).sum(-1) / np.maximum((side * weights).sum(-1), 1e-12) for side in (left, every - left))
    parts = (left.sum(-1) > 0) & (left.sum(-1) < every.sum(-1))
    pure = np.where(parts, np.round(pure / np.maximum((every * weights).sum(-1), 1e-12), 9), -1.0)
    return np.where(parts.any(-1), pure.argmax(-1), -1)


def grow(df: DataFrame, trees: int, depth: int, seeds: tuple[int, ...], weights: tuple[float, float] = (1.0, 1.0), tries: int | None = None) -> list[Forest]:
    """``df(features, label)``, arrays of one length without nulls and labels 0 and 1 -> a forest for each seed.

    ``weights`` are the labels' weights. Each node tries ``tries`` features (the root of their number by default). A node whose rows no try parts
    sends all of them left; a node without rows has the share of the one above. An empty table gives trees of one half.
    """
    first = df.select(F.size("features").alias("n")).first()
    width = first["n"] if first else 1
    tries = tries or max(1, int(width**0.5))
    n, inner = trees * len(seeds), 2**depth - 1
    feature, cut = np.zeros((n, inner), np.int64), np.full((n, inner), np.inf)
    rngs = [np.random.default_rng(seed) for seed in seeds]
    low, high = (np.tile(e, (n, 1, 1)) for e in bounds(df, width))
    share = np.full((n, 1), 0.5)
    for level in range(depth + 1):
        f, c = draws(rngs, trees, low, high, tries) if level < depth else (np.zeros((n, 2**level, 0), np.int64), np.zeros((n, 2**level, 0)))
        counts = count(df, width, feature, cut, level, f, c)
        every = counts[:, :, -1] * weights
        above = np.repeat(share, 2, 1) if level else share
        share = np.where(every.sum(-1) > 0, every[..., 1] / np.maximum(every.sum(-1), 1e-12), above)
        if level == depth:
            break
        pick = best_cuts(counts, weights)[..., None]
        own_f, own_c = (np.where(pick >= 0, np.take_along_axis(a, np.maximum(pick, 0), 2), none)[..., 0] for a, none in ((f, 0), (c, np.inf)))
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        feature[:, at], cut[:, at] = own_f, own_c
        low, high = np.repeat(low, 2, 1), np.repeat(high, 2, 1)
        t, m = np.nonzero(pick[..., 0] >= 0)
        high[t, 2 * m, own_f[t, m]] = low[t, 2 * m + 1, own_f[t, m]] = own_c[t, m]
    return [Forest(feature[k : k + trees], cut[k : k + trees], share[k : k + trees]) for k in range(0, n, trees)]


def probability(forest: Forest, features: Column) -> Column:
    """The forest's share of label 1 for arrays of features, in Arrow batches."""

    def p1(x):
        return pa.array(forest.p1(matrix_of(x, len(x[0])))) if len(x) else pa.array([], pa.float64())

    p1.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(p1, "double")(features.cast("array<double>"))
