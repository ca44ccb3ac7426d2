"""Whitening against whole-number covariances and float64 eigenvectors."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tomewright.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, n long, component string"


def frame(spark, vectors, kind=ROWS):
    return spark.createDataFrame([(i, v, 5, "kept") for i, v in enumerate(vectors)], kind)


def plain(vectors):
    """Deviations and the covariance, in fractions."""
    x = [[floor(Fraction(c) * 64) + 1_000_000 for c in np.float32(v).tolist()] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    cov = [[float(sum(Fraction(n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x)
                  / n ** 3) for j in range(d)] for i in range(d)]
    return deviation, np.array(cov), np.array(x) - np.array([s / n for s in sums])


@pytest.mark.parametrize("spread", [[5, 4, 3, 2, 1, .5], [3, 3, 3, 1, 1, 1], [1, 1, 1, 1, 1, 1]])
def test_matches_plain(spark, spread):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(150, 6)) * spread + 2).astype(np.float32).tolist()
    vectors += vectors[:40]
    df = frame(spark, vectors).repartition(5)
    model = W.fit(df, components=4)
    rows = W.components(df, model).collect()
    deviation, cov, centred = plain(vectors)
    values, directions = np.linalg.eigh(cov)
    assert len(rows) == 190 * 4
    got = np.zeros((190, 4))
    for r in rows:
        assert r["n"] == 190 and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[-r["component"]] / values.sum(), rel=1e-12)
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = centred @ directions[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    for k in range(4):
        assert min(np.abs(got[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-9
    assert np.abs(got.T @ got / 190 - np.eye(4)).max() < 1e-9
    assert model.identity_error < 1e-9


def test_clusters_are_told_apart():
    """Eigenvalues a billionth apart, which float32 and float64 products mix up."""
    rng = np.random.default_rng(1)
    wide = np.longdouble
    true = np.array([1 + 1e-9 * k for k in range(8)] + [1e-5 * (1 + 1e-6 * k) for k in range(8)],
                    wide)
    q = np.linalg.qr(rng.normal(size=(16, 16)))[0].astype(wide)
    for _ in range(3):
        q = q @ (wide(1.5) * np.eye(16) - q.T @ q / 2)
    a = (q * true) @ q.T
    values, x = W.eigenvectors((a + a.T) / 2)
    by, true_by = np.argsort(values), np.argsort(true)
    assert np.abs(x.T @ x - np.eye(16)).max() < 1e-17
    assert np.abs(np.sort(values) - np.sort(true)).max() < 1e-17
    assert (1 - np.abs((x[:, by] * q[:, true_by]).sum(axis=0))).max() < 1e-15


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(5), np.ones((4, 4)), np.diag([1e-30, 1.0]),
                               np.zeros((0, 0))])
def test_degenerate_matrices(a):
    values, x = W.eigenvectors(a.astype(np.longdouble))
    assert np.abs(x.T @ x - np.eye(len(a))).max(initial=0) < 1e-17
    assert np.abs(a @ x - x * values).max(initial=0) < 1e-17


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 0.5], [0.0, 1.0], [0.25, -3.0]]
    odd = [None, [], [nan, 1.0], [1.0, None], [inf, 0.0], [1.0], [1.0, 2.0, 3.0]]
    df = frame(spark, good + odd)
    done = W.whiten(df, W.fit(df)).collect()
    assert sorted(r["vec_id"] for r in done) == [0, 1, 2, 3]
    assert all(r["n"] == 5 and r["component"] == "kept" and len(r["whitened"]) == 2 for r in done)
    one = frame(spark, [[1.0, 2.0]] * 3)
    model = W.fit(one)
    assert [r["whitened"] for r in W.whiten(one, model).collect()] == [[0.0, 0.0]] * 3
    assert model.identity_error == 0 and not model.explained.any()
    for none in (frame(spark, []), frame(spark, [None, [nan]])):
        assert W.components(none, W.fit(none)).collect() == []


def test_huge_entries_are_exact(spark):
    """Products beyond 2^53, and deviations beyond a long."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(50, 3)) * 2.0 ** 40).tolist()
    df = frame(spark, vectors, ROWS.replace("float", "double"))
    model = W.fit(df)
    x = [[floor(Fraction(c) * 64) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(r[k] for r in x) for k in range(3)]
    cov = np.array([[float(Fraction(sum((50 * r[i] - sums[i]) * (50 * r[j] - sums[j])
                                        for r in x), 50 ** 3)) for j in range(3)]
                    for i in range(3)])
    assert np.allclose(model.values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-13)
    assert model.identity_error < 1e-9
    assert all(r["deviation"] is None for r in W.whiten(df, model).collect())
