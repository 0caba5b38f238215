"""Exact nearest neighbours by a block matrix join with int8 tiles.

1. Vectors are packed into blocks of rows: the originals, and unit vectors
   rounded to int8 with one scale each. The norm of a vector's rounding error is
   kept, so an int8 product bounds the true cosine from both sides
   (Cauchy-Schwarz).
2. Query blocks and candidate blocks meet on a grid: candidates go to the cells
   of their column, queries to those of their row, a bounded number of blocks a
   cell. No cell holds more than a few tiles and none depends on how vectors are
   spread, so a hot vector or label makes no hot cell.
3. In a cell, each tile's int8 products give every pair an upper and a lower
   bound. Pairs whose upper bound does not reach the query's k-th best so far
   (exact from earlier tiles, or the k-th lower bound of this one) are out; the
   survivors' cosines are computed again in double precision on the originals
   and merged into one heap of k a query. Ties survive, so the result is exact.
4. Each cell sends k rows a query; a top-k window over those merges the cells.

Defined results: rows with a null id, and vectors that are null, empty, zero or
hold null or non-finite values take no part; vectors compare with those of
their own length only; a query meets every row but those of its own id; an id
with several rows is queried once, with the smallest of its vectors; fewer than
k candidates give them all; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows of a candidate and of a query block; blocks of each that a cell should hold.
ROWS, QUERIES, CELL_ROWS, CELL_QUERIES = 4096, 1024, 8, 4
#: Room for rounding in the bounds themselves.
_SLACK = 1e-6
_BLOCK = "dim int, n int, ids binary, vectors binary, codes binary, scales binary, errors binary"


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and the norms of the errors."""
    unit = v / norms(v)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(np.square(unit - codes * scale[:, None]).sum(axis=1))


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths, safe from overflow and underflow of the squares."""
    top = np.abs(v).max(axis=1)
    return top * np.sqrt(np.square(v / top[:, None]).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: float32 holds sums of 1024 products of int8 codes."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        total += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are first divided by their largest
    value where a square could leave the range of doubles."""
    for x in (a, b):
        top = np.abs(x).max(axis=1)
        if ((top < 1e-120) | (top > 1e120)).any():
            return cosines(a / np.abs(a).max(axis=1)[:, None], b / np.abs(b).max(axis=1)[:, None])
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


class _Block:
    def __init__(self, row: dict) -> None:
        n, dim = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, dim)
        self.scales, self.errors = np.frombuffer(row["scales"]), np.frombuffer(row["errors"])
        self.lengths = self.scales * np.sqrt(np.square(self.codes.astype(np.float64)).sum(axis=1))


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                values = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                for k in range(0, len(at), rows):
                    v = np.ascontiguousarray(values[k : k + rows])
                    codes, scale, error = quantise(v)
                    row = [int(dim), len(v), ids[at[k : k + rows]].tobytes(), v.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    return run


def _cell(k: int):
    def run(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        others = [_Block(c) for c in candidates.to_dict("records")]
        for q in map(_Block, queries.to_dict("records")):
            heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]
            for c in others:
                _tile(q, c, k, heaps)
            out += [(int(i), -n, s) for i, heap in zip(q.ids, heaps, strict=True) for s, n in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _tile(q: _Block, c: _Block, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Merge one tile into the queries' heaps of (score, -id), the worst on top."""
    near = int8_products(q.codes, c.codes) * q.scales[:, None] * c.scales[None, :]
    room = np.outer(q.lengths, c.errors) + np.outer(q.errors, c.lengths + c.errors) + _SLACK
    own = q.ids[:, None] == c.ids[None, :]
    low = np.where(own, -np.inf, near - room)
    least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if low.shape[1] > k:
        least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    a, b = np.nonzero((near + room >= least[:, None]) & ~own)
    score = np.concatenate([np.empty(0), *(cosines(q.vectors[a[i : i + 32768]], c.vectors[b[i : i + 32768]]) for i in range(0, len(a), 32768))])
    order = np.lexsort((c.ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    start = np.searchsorted(a, a)
    best = np.arange(len(a)) - start < k  # no other can enter the heap
    for i, n, s in zip(a[best].tolist(), c.ids[b[best]].tolist(), score[best].tolist(), strict=True):
        if len(heaps[i]) < k:
            heapq.heappush(heaps[i], (s, -n))
        elif (s, -n) > heaps[i][0]:
            heapq.heapreplace(heaps[i], (s, -n))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    chosen = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    return chosen.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each query by cosine."""
    left = usable(queries, vec_id, embedding).groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector")
    rows, asked = stage(usable(candidates, vec_id, embedding).mapInArrow(_pack(ROWS), _BLOCK), "vectors"), stage(left.mapInArrow(_pack(QUERIES), _BLOCK), "queries")
    across, down = -(-rows.count() // CELL_ROWS), -(-asked.count() // CELL_QUERIES)
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(max(1, n)))
    grid = lambda df, own, n, other, m: df.withColumn(own, place(n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, m) - 1).cast("long"))))
    cells = grid(asked, "down", down, "across", across).groupBy("dim", "down", "across").cogroup(grid(rows, "across", across, "down", down).groupBy("dim", "down", "across"))
    found = cells.applyInPandas(_cell(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """The contract's rows: queries are the rows whose vec_id is divisible by `every`."""
    return nearest(embeddings, embeddings.filter(F.col("vec_id") % every == 0))
