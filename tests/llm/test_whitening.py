"""Whitening against numpy's own eigenvectors, its parts against plain forms, and odd tables."""

import math

import numpy as np
import pytest

from pathloom.llm import whitening


def table_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(rng.integers(0, 3, n).astype(float)), np.ones((n, n)), np.zeros((n, n)), np.diag(10.0 ** -np.arange(n))):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * np.abs(a).max(initial=0))
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * max(np.abs(a).max(initial=0), 1e-300))


def test_moments_merge_to_those_of_all_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * 10 + 1e5
    parts = []
    for part in np.split(x, [0, 7, 7, 120]):
        m = whitening.Moments(5)
        for row in part:
            m.add(row)
        parts.append(m)
    whole = whitening.Moments(5)
    for m in parts:
        whole.merge(m.n, m.mean, m.products, m.total)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(0), rtol=1e-14)
    assert np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-10)


def test_equals_numpys_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 20)) @ (rng.normal(size=(20, 20)) * 0.2)).astype(np.float32)
    bad = [None, [], [1.0], [None] * 20, [float("nan")] + [0.0] * 19, [float("inf")] + [0.0] * 19, [3e7] + [0.0] * 19]
    got = whitening.whiten(table_of(spark, [*x.tolist(), *bad]).repartition(7)).collect()
    whole = [[math.floor(1024 * float(c)) + 100000 for c in row] for row in x]
    total = [sum(c) for c in zip(*whole)]
    v = np.array(whole, float)
    values, basis = np.linalg.eigh(np.cov(v.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    want = (v - v.mean(0)) @ basis[:, :8] / np.sqrt(values[:8])
    assert len(got) == 500 * 8 and {r["n"] for r in got} == {500}
    out = np.zeros((500, 8))
    for r in got:
        out[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["deviation"] == sum((500 * c - s) ** 2 for c, s in zip(whole[r["vec_id"]], total))
        assert r["identity_error"] < 1e-9
    sign = np.sign((out * want).sum(0))
    assert np.allclose(out * sign, want, atol=1e-8)


def test_deviations_beyond_a_long_are_null():
    big = np.array([[3_100_000_000, 5], [1, 2], [2_000_000_000, -2_000_000_000]])
    assert whitening.exact_deviation(big) == [None, 5, 8 * 10**18]


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[None, 1.0]]])
def test_tables_without_variance_give_no_row(spark, vectors):
    assert whitening.whiten(table_of(spark, vectors)).count() == 0


def test_repeated_and_missing_ids_ragged_vectors_and_flat_components(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (None, [1.0, 1.0, 2.0]), (2, [2.0, 1.0, 2.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as component", "3 as slot", "4 as vector")
    got = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1)]  # two dimensions don't vary
    assert {r["n"] for r in got} == {4} and all(r["explained"] == pytest.approx(1) for r in got)


def test_what_sql_can_say(same_as_sql):
    same_as_sql(whitening.deviations, whitening.BASE_SQL)
