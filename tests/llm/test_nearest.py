"""Nearest neighbours against brute force in double precision."""

import numpy as np
import pytest

from spanloom.llm import nearest


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0 and (i not in queries or tuple(v) < tuple(queries[i])):
            queries[i] = v
    out = set()
    for q, v in queries.items():
        got = []
        for i, w in ok:
            if i != q and len(v) == len(w):
                a, b = v / np.abs(v).max(), w / np.abs(w).max()
                got.append((-np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), i))
        got = sorted((round(s, 9), i) for s, i in got)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(got, 1)}
    return out


def check(spark, rows, monkeypatch, block=16):
    for name, n in (("ROWS", block), ("QUERIES", 4), ("CELL_ROWS", 2), ("CELL_QUERIES", 1)):
        monkeypatch.setattr(nearest, name, n)
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<double>, id int, score string")
    got = nearest.neighbours(table).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


@pytest.mark.parametrize("dim", [3, 64])
def test_random(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, np.round(rng.normal(size=dim), 3).tolist()) for i in range(400)]
    check(spark, rows, monkeypatch)


def test_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(9)
    same = rng.normal(size=4).tolist()
    rows = [(i, same) for i in range(0, 120)] + [(i, rng.normal(size=4).tolist()) for i in range(200, 260)]
    rows += [(300, None), (350, []), (400, [0.0] * 4), (450, [1.0, None, 2.0, 3.0]), (500, [float("nan"), 1.0, 1.0, 1.0]), (550, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, same), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (650, [1e300, 1e300, 0.0, 1e-300]), (651, [1e-300, 2e-300, 0.0, 0.0]), (250, same), (210, same), (210, same)]
    check(spark, rows, monkeypatch)


def test_empty(spark):
    assert nearest.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 1500)) * np.exp(rng.normal(size=(200, 1)))
    codes, scale, error = nearest.quantise(v)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = nearest.int8_products(codes, codes)
    assert (got == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    length = scale * np.linalg.norm(codes.astype(float), axis=1)
    room = np.outer(length, error) + np.outer(error, length + error)
    assert (np.abs(got * np.outer(scale, scale) - u @ u.T) <= room + 1e-12).all()
