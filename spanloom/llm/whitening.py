"""Whitening of embeddings by the leading principal components.

1. Entries become integers floor(scale * c) + shift. Counts and sums a dimension
   are exact; one more pass adds up the centred products of each task's rows, so
   what leaves a task are d (d + 1) / 2 numbers, added up by the dimension pair.
2. The covariance (d x d, whatever the rows) is made tridiagonal by Householder
   reflections; Sturm counts bisect for the leading eigenvalues, all at once;
   inverse iteration on the tridiagonal matrix gives their vectors, those of close
   eigenvalues (a cluster) made orthogonal to each other in every round; the
   reflections carry them back.
3. The projection (d x k) is broadcast and applied to every vector. Means and
   covariance of the whitened rows are then taken from the staged result.

Defined results: vectors that are null or hold null or non-finite entries take no
part; rows with a null id are whitened as well, repeated rows count each; vectors
of each length are a fit list of their own, and empty vectors have no components;
components without variance (rounding of the largest, at most) are left out, so a
single row or equal rows give none; equal eigenvalues have some orthonormal
vectors of their space, the same for all rows; an entry outside +-2^40 after
scaling is an error; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import stage

SCALE, SHIFT = 1024, 100_000
#: Entries after scaling stay below this, so that sums of 2^22 of them are exact in a task.
LIMIT = 2**40
#: Rows that are centred and multiplied at once.
BLOCK = 8192
#: Eigenvalues closer than this part of the largest form a cluster.
NEAR = 1e-3


@dataclass(frozen=True)
class Model:
    """The whitening of vectors of one length: rows, sums a dimension, eigenvalues
    (largest first), unit vectors (a column each) and the trace of the covariance."""

    rows: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part."""
    chosen = table.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    return chosen.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vector") > 0))


def integers(values: np.ndarray) -> np.ndarray:
    whole = np.floor(SCALE * values)
    if (np.abs(whole) >= LIMIT).any():
        raise ValueError("an entry is too large for exact sums")
    return whole.astype(np.int64) + SHIFT


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places of the rows, integer rows), at most BLOCK rows at once."""
    lists = batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        for k in range(0, len(at), BLOCK):
            part = at[k : k + BLOCK]
            yield int(dim), part, integers(lists.take(pa.array(part)).flatten().to_numpy().reshape(-1, dim))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, subtracted before anything is rounded."""
    return (n * x - sums) / n if n * max(1, int(np.abs(x).max(initial=0))) < 2**62 else ((n * x.astype(object) - sums) / n).astype(float)


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and exact sums a dimension for each length of vectors: d numbers a length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_length(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(part))), pa.array(x.sum(axis=0))], ["dim", "i", "rows", "total"])

    added = rows.select("vector").mapInArrow(add, "dim int, i int, rows long, total long")
    found = added.groupBy("dim", "i").agg(F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one row a dimension
    out: dict[int, tuple[int, np.ndarray]] = {}
    for dim in {r["dim"] for r in found}:
        mine = sorted((r["i"], r["rows"], int(r["total"])) for r in found if r["dim"] == dim)
        out[dim] = (mine[0][1], np.array([m[2] for m in mine], np.int64))
    return out


def covariances(rows: DataFrame, known: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The covariance (divisor n) of each length: centred before multiplying."""
    told = rows.sparkSession.sparkContext.broadcast(known)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch):
                y = centred(x, *told.value[dim])
                total[dim] = total.get(dim, 0) + y.T @ y
        for dim, products in total.items():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(products[i, j])], ["dim", "i", "j", "product"])

    added = rows.select("vector").mapInArrow(multiply, "dim int, i int, j int, product double")
    found = added.groupBy("dim", "i", "j").agg(F.sum("product").alias("product")).toPandas()  # d (d + 1) / 2 rows a length
    out = {}
    for dim, mine in found.groupby("dim"):
        v = np.zeros((dim, dim))
        v[mine["i"], mine["j"]] = v[mine["j"], mine["i"]] = mine["product"] / known[dim][0]
        out[int(dim)] = v
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and the Householder reflections (where they start, unit vector)."""
    a, turns = a.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        if not np.abs(x[1:]).max():
            continue
        v = x / np.abs(x).max()  # no square leaves the range of doubles
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        turns.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are below each x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for k in range(len(d)):
        q = d[k] - x - (e[k - 1] ** 2 / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, largest first, bisected until no double lies between."""
    reach = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    room = np.finfo(float).eps * max(1e-300, np.abs([low[0], high[0]]).max())
    low, high, place = low - room, high + room, len(d) - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        over = below(d, e, middle) > place
        low, high = np.where(over, low, middle), np.where(over, middle, high)


def solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a vanishing pivot is
    replaced by a rounding error, as inverse iteration wants it."""
    n, floor = len(d), np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0), 1e-300)
    main, up, far, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    low = np.append(e, 0.0)
    for k in range(n - 1):
        if abs(low[k]) > abs(main[k]):
            main[k], low[k] = low[k], main[k]
            up[k], main[k + 1] = main[k + 1], up[k]
            far[k], up[k + 1] = up[k + 1], far[k]
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(main[k]) < floor:
            main[k] = floor
        m = low[k] / main[k]
        main[k + 1] -= m * up[k]
        up[k + 1] -= m * far[k]
        x[k + 1] -= m * x[k]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (far[k] * x[k + 2] if k + 2 < n else 0)) / main[k]
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit vectors of T for the given eigenvalues, a column each. Those of a
    cluster start apart and are made orthogonal to the ones before in each round."""
    out, first = np.zeros((len(d), len(values))), 0
    eps, largest = np.finfo(float).eps, max(np.abs(values).max(), 1e-300)
    for k, value in enumerate(values):
        if k and values[k - 1] - value > NEAR * largest:
            first = k
        shift = value - (k - first) * 4 * eps * largest  # equal values get shifts of their own
        x = np.random.default_rng(k).normal(size=len(d))
        for _ in range(rounds):
            x = solve(d, e, shift, x / np.abs(x).max())
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.sqrt(x @ x)
        out[:, k] = x
    return out


def eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues and unit vectors of a symmetric matrix."""
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(k), np.eye(len(a))[:, :k]
    d, e, turns = tridiagonal(a / scale)
    values = leading(d, e, k)
    x = vectors(d, e, values)
    for at, v in reversed(turns):
        x[at:] -= 2 * np.outer(v, v @ x[at:])
    return values * scale, x


def fit(rows: DataFrame, components: int = 8) -> dict[int, Model]:
    """A model for each length of vectors (rows: as usable() gives them)."""
    known = moments(rows)
    models = {}
    for dim, v in covariances(rows, known).items():
        values, units = eigen(v, min(components, dim))
        told = values > dim * np.finfo(float).eps * 16 * max(values[0], 0)
        models[dim] = Model(*known[dim], values[told], units[:, told], float(np.trace(v)))
    return models


def transform(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """id, dim, deviation (exact, sum over dimensions of (n*x-S)^2) and whitened, an array."""
    told = rows.sparkSession.sparkContext.broadcast(models)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_length(batch):
                m = told.value[dim]
                white = centred(x, m.rows, m.sums) @ (m.vectors / np.sqrt(m.values))
                wide = m.rows * max(1, int(np.abs(x).max(initial=0))) * 2 >= 2**31 // max(1, int(np.sqrt(dim)) + 1)
                off = m.rows * (x.astype(object) if wide else x) - m.sums
                far = [int(v) for v in (off * off).sum(axis=1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(part)), pa.array(np.full(len(part), dim, np.int32)), pa.array(far, pa.decimal128(38, 0)), lists], ["id", "dim", "deviation", "whitened"])

    return rows.mapInArrow(project, "id long, dim int, deviation decimal(38,0), whitened array<double>")


def identity_errors(white: DataFrame) -> dict[int, float]:
    """Of each length, the largest absolute entry of the whitened rows' covariance
    minus the identity; the means are subtracted before multiplying."""
    means: dict[int, dict[int, float]] = {}
    for r in white.select("dim", F.posexplode("whitened").alias("i", "w")).groupBy("dim", "i").agg(F.avg("w").alias("mean")).collect():  # a row a component
        means.setdefault(r["dim"], {})[r["i"]] = r["mean"]
    out = {}
    for dim, mean in means.items():
        k = len(mean)
        off = [F.col("whitened")[i] - F.lit(mean[i]) for i in range(k)]
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = white.filter(F.col("dim") == dim).agg(*[F.avg(off[i] * off[j]) for i, j in pairs]).first()
        out[dim] = max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs, strict=True))
    return out


def whiten(table: DataFrame, components: int = 8) -> DataFrame:
    """The contract's rows. A deviation beyond the range of a long is null here; transform() has it whole."""
    rows = usable(table)
    models = fit(rows, components)
    white = stage(transform(rows, models), "whitened")
    errors = identity_errors(white)
    spark = table.sparkSession
    facts = spark.createDataFrame([(d, m.rows, i, float(e / m.trace), float(errors[d])) for d, m in models.items() for i, e in enumerate(m.values)], "dim int, n long, i int, explained double, identity_error double")  # a row a component
    each = white.select("id", "dim", "deviation", F.posexplode("whitened").alias("i", "w")).join(F.broadcast(facts), ["dim", "i"])
    return each.select(F.col("id").alias("vec_id"), (F.col("i") + 1).alias("component"), "n", F.col("deviation").try_cast(LongType()).alias("deviation"), F.col("w").alias("whitened"), "explained", "identity_error")
