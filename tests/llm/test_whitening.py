"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, component string, n string"


def frame(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if c is None else float(c) for c in v], "clash", "clash", "clash") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def dense(x, k):
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    v = c.T @ c / n
    e, p = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    e, p = e[order], p[:, order]
    return n, s, e / np.trace(v), (x - s / n) @ p / np.sqrt(e)


def compare(got, ids, x, k, tolerance=1e-9):
    n, s, share, white = dense(x, k)
    made = np.full((len(x), k), np.nan)
    at = {i: j for j, i in enumerate(ids)}
    assert len(got) == len(x) * k
    for r in got:
        made[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n
        assert r.deviation == int(((n * x[at[r.vec_id]].astype(object) - s) ** 2).sum())
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9)
        assert r.identity_error <= 1e-9
    assert np.abs(made * np.sign((made * white).sum(axis=0)) - white).max() < tolerance


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ np.diag(1 + 1 / np.arange(1, d + 1)) / 3).astype(np.float32)


@pytest.mark.parametrize(("d", "settings"), [(64, {}), (40, {"block": 8, "basis": 20}), (40, {"block": 40}), (5, {}), (4, {"block": 4})])
def test_equals_the_dense_solution(spark, d, settings):
    v = vectors(300, d)
    v = np.vstack([v, np.repeat(v[:1], 100, axis=0)])  # copies count once in the fit, each in the result
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    compare(whitening.whiten(frame(spark, v), **settings).collect(), range(len(v)), x, min(4, d))


def test_odd_rows(spark):
    v = vectors(60, 6, seed=3)
    odd = [None, [], [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e30] * 6, [0.5] * 3, [-0.0] * 6]
    df = frame(spark, [*v, *odd, v[0]], [*range(60), *range(100, 108), None])
    got = whitening.whiten(df).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [*range(60), 107]
    x = np.floor(256 * np.vstack([v, np.zeros((1, 6)), v[:1]]).astype(np.float64)).astype(np.int64)
    compare(got, [*range(60), 107, None], x, 4)


def test_without_variance_and_empty(spark):
    one = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 6
    line = whitening.whiten(frame(spark, [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]])).collect()
    assert {r.component: r.explained for r in line} == {1: pytest.approx(1.0), 2: 0.0}
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert whitening.whiten(frame(spark, [None])).collect() == []
    assert whitening.whiten(frame(spark, [[1.0]]).limit(0)).collect() == []


def test_equal_eigenvalues_and_large_values(spark):
    v = [[a * 1000.0, b * 1000.0] for a in (-1, 1) for b in (-1, 1)]
    got = whitening.whiten(frame(spark, v)).collect()
    assert all(abs(sum(r.whitened**2 for r in got if r.vec_id == i) - 2) < 1e-9 for i in range(4))
    big = [[float(2**43), 0.0], [0.0, 1.0], [1.0, 0.0]]
    got = whitening.whiten(frame(spark, big)).collect()
    assert any(r.deviation is None for r in got) and all(r.n == 3 for r in got)


def test_exact_sums(spark):
    fit = spark.range(1000).select(F.array(F.lit(2**51) + F.col("id"), -F.col("id")).alias("x"))
    n, sums = whitening._sums(fit, 2)
    assert (n, sums) == (1000, [1000 * 2**51 + 499_500, -499_500])
