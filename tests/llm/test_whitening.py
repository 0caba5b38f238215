"""Whitening against numpy's eigenvalues and exact integers."""

import math

import numpy as np
import pytest

from spanloom.llm import whitening


@pytest.mark.parametrize("n", [1, 2, 3, 5, 20, 64, 150])
def test_eigen(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    for values in (rng.uniform(1, 9, n), np.full(n, 3.0), np.repeat([5.0, 1.0], [n - n // 2, n // 2]), 10.0 ** -np.arange(n), np.r_[np.full(n - n // 3, 7.0), np.linspace(6.999999, 7, n // 3)]):
        for scale in (1.0, 1e200, 1e-200):
            a = (q * values) @ q.T * scale
            a = (a + a.T) / 2
            k = min(8, n)
            got, x = whitening.eigen(a, k)
            want = np.sort(np.linalg.eigvalsh(a / scale))[::-1][:k] * scale
            assert np.abs(got - want).max() <= 1e-13 * max(want[0], 0) * n
            assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12
            assert np.abs((a / scale) @ x - x * (got / scale)).max() <= 1e-13 * n * max(want[0] / scale, 0)


@pytest.mark.parametrize("a", [np.zeros((4, 4)), np.eye(5), np.diag([3.0, 1.0, 2.0]), np.array([[2.0]])])
def test_eigen_of_plain_matrices(a):
    k = min(8, len(a))
    got, x = whitening.eigen(a, k)
    assert np.allclose(got, np.sort(np.diag(a))[::-1][:k]) and np.allclose(a @ x, x * got) and np.allclose(x.T @ x, np.eye(k))


def brute(rows, k=8):
    """{(id, component): (n, deviation, |whitened|, explained)} with repeats as a list."""
    out = {}
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v)]
    for dim in {len(v) for _, v in fine}:
        mine = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in fine if len(v) == dim]
        n, sums = len(mine), [sum(x[j] for _, x in mine) for j in range(dim)]
        off = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for _, x in mine], dtype=object)
        y = (off / n).astype(float)
        v = y.T @ y / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for (i, _), far, row in zip(mine, (off * off).sum(axis=1), y, strict=True):
            for c in range(min(k, dim)):
                if e[c] > 1e-9 * e[0]:
                    out.setdefault((i, c + 1), []).append((n, far, abs(row @ u[:, c]) / math.sqrt(e[c]), e[c] / np.trace(v)))
    return out


def check(spark, rows, tolerance=1e-8):
    table = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<double>, id int, dim string, whitened double")
    got = whitening.whiten(table).collect()
    want = brute(rows)
    assert len(got) == sum(map(len, want.values()))
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert set(seen) == set(want)
    for key, mine in seen.items():
        for a, b in zip(sorted(mine), sorted(want[key]), strict=True):
            assert a[0] == b[0] and a[1] == (b[1] if b[1] < 2**63 else None)
            assert abs(a[2] - b[2]) < tolerance * max(1, b[2]) and abs(a[3] - b[3]) < 1e-10
    assert all(r.identity_error < 1e-9 for r in got)
    for c in {r.component for r in got}:  # one sign for all rows: components are uncorrelated and centred
        assert abs(sum(r.whitened for r in got if r.component == c)) < 1e-6 * len(got)


def test_random(spark):
    rng = np.random.default_rng(1)
    check(spark, [(i, (rng.normal(size=16) * np.linspace(1, 9, 16) + 5).tolist()) for i in range(500)])


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(7, [1.0, 2.0, 3.0])] * 5 + [(None, [0.5, -0.5, 30.0])]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 0.0, 0.0])]
    rows += [(200 + i, [float(i), 1.0]) for i in range(5)] + [(300, [1.0, 2.0, 3.0, 4.0])]  # a length with one component, one without
    check(spark, rows)
    wide = [(i, [float(x) for x in rng.integers(-(2**28), 2**28, 4)]) for i in range(30)]  # deviations beyond a long
    check(spark, wide)


def test_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    with pytest.raises(ValueError, match="too large"):
        whitening.integers(np.array([1e300]))
