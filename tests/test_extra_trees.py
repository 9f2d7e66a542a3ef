"""Distributed extremely randomised trees against growth over whole arrays, and what any tree must hold."""

import numpy as np
import pytest

from pathloom.operators import extra_trees


def table_of(spark, x, y, parts):
    return spark.createDataFrame([([float(v) for v in row], int(k)) for row, k in zip(x, y)], "features array<double>, label int").repartition(parts)


def plain(x, y, trees, depth, seeds, weights, tries):
    """The same draws, each node's rows picked by masks over whole arrays, cut by cut."""
    n, inner = trees * len(seeds), 2**depth - 1
    feature, cut, share = np.zeros((n, inner), int), np.full((n, inner), np.inf), np.full((n, 2**depth), 0.5)
    rngs = [np.random.default_rng(s) for s in seeds]
    box = [[(x.min(0), x.max(0))] for _ in range(n)]
    rows = [[np.arange(len(x))] for _ in range(n)]
    above = [[0.5] for _ in range(n)]
    w = np.array(weights)[y]
    for level in range(depth + 1):
        own = [[(w[r] * y[r]).sum() / w[r].sum() if len(r) else above[t][m // 2 if level else 0] for m, r in enumerate(rows[t])] for t in range(n)]
        if level == depth:
            for t in range(n):
                share[t] = own[t]
            return feature, cut, share
        low, high = (np.array([[b[k] for b in box[t]] for t in range(n)]) for k in (0, 1))
        f, c = extra_trees.draws(rngs, trees, low, high, tries)
        for t in range(n):
            new_rows, new_box = [], []
            for m, r in enumerate(rows[t]):
                best = None
                for k in range(tries):
                    left = x[r, f[t, m, k]] <= c[t, m, k]
                    if 0 < left.sum() < len(r):
                        pure = sum(((w[s] * y[s]).sum() ** 2 + (w[s] * (1 - y[s])).sum() ** 2) / w[s].sum() for s in (r[left], r[~left]))
                        pure = round(pure / w[r].sum(), 9)
                        if best is None or pure > best[0]:
                            best = (pure, f[t, m, k], c[t, m, k], left)
                a, b = box[t][m]
                if best is None:
                    new_rows += [r, r[:0]]
                    new_box += [(a, b), (a, b)]
                else:
                    _, i, v, left = best
                    feature[t, 2**level - 1 + m], cut[t, 2**level - 1 + m] = i, v
                    new_rows += [r[left], r[~left]]
                    lo, hi = a.copy(), b.copy()
                    hi[i] = lo[i] = v
                    new_box += [(a, hi), (lo, b)]
            rows[t], box[t] = new_rows, new_box
        above = own


@pytest.mark.parametrize("parts,batch", [(1, 4096), (5, 7)])
def test_trees_equal_those_grown_over_whole_arrays(spark, monkeypatch, parts, batch):
    """However rows are dealt and counted: features, cuts and shares, for several forests with weighted labels."""
    monkeypatch.setattr(extra_trees, "ROWS", batch)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(90, 5)), np.repeat(rng.normal(size=(1, 5)), 6, 0)])
    y = (x[:, 1] + 0.3 * rng.normal(size=96) > 0.4).astype(int)
    got = extra_trees.grow(table_of(spark, x, y, parts), 4, 4, (30, 44), (0.7, 1.9), tries=3)
    feature, cut, share = plain(x, y, 4, 4, (30, 44), (0.7, 1.9), 3)
    assert (np.concatenate([f.feature for f in got]) == feature).all()
    assert np.allclose(np.concatenate([f.cut for f in got]), cut) and np.allclose(np.concatenate([f.share for f in got]), share)


def test_trees_learn_and_predict_in_spark(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 9))
    y = (x[:, 0] * x[:, 3] > 0).astype(int)
    df = table_of(spark, x, y, 4)
    forest = extra_trees.grow(df, 40, 7, (3,))[0]
    out = df.withColumn("p", extra_trees.probability(forest, df["features"])).collect()
    assert all(0 <= r["p"] <= 1 for r in out) and sum((r["p"] > 0.5) == r["label"] for r in out) / len(out) > 0.8
    assert all(abs(r["p"] - forest.p1(np.array([r["features"]]))[0]) < 1e-12 for r in out[:20])
    assert len({forest.cut[t].tobytes() for t in range(40)}) == 40


def test_one_label_equal_rows_and_no_rows(spark):
    one = extra_trees.grow(table_of(spark, np.ones((5, 2)), np.ones(5, int), 2), 3, 2, (1,))[0]
    assert np.isinf(one.cut).all() and (one.share == 1).all()
    none = extra_trees.grow(spark.createDataFrame([], "features array<double>, label int"), 2, 2, (1,))[0]
    assert (none.share == 0.5).all()
