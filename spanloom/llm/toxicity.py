"""Toxicity by a classifier chain over linear models.

The categories are columns of the label table, predicted in order; the model of
a later category sees the log odds of the earlier ones. While training, those
come from models that did not see the row (out of fold), so that the chain
learns from probabilities as uncertain as the ones it gets later.

Features: whole words and word stems (the first 4 to 7 letters), lower-cased.
A feature's value is how far its count in a text exceeds what the text's length
and its rate among negative rows lead to expect, in standard deviations,
clipped; so one stray word in a long clean text weighs little. Features are
chosen by chi square on documents, at most `features` of them.

Training uses at most `sample` labelled rows, those with the smallest hash of
doc_id: a documented bound, and 12,000 rows settle a few hundred weights. They
are staged, one text an id, so that training reads the documents once. Word
counts for choosing features are made in Spark; the design matrix (sample x
features) is fitted on the driver. Scoring covers every row and whole texts in
one pass without a shuffle; the weights broadcast are bounded by `features`.

Defined results: a null or wordless text scores the models' intercepts;
repeated rows score each, and of several texts of one labelled id the smallest
is learned from; a null doc_id is never a training row; label rows with a null
are left out, of several for one id the largest counts; a category
with one class only predicts its rate; an empty table gives an empty result;
columns beyond text and doc_id pass through untouched whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, pack, stage, trim

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7)
_CACHE = 200_000
#: Rows of the design matrix that the fit works on at a time.
_ROWS = 1024


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in _STEMS if len(word) > k)]


@dataclass(frozen=True)
class Chain:
    """names: categories in order; vocabulary: feature to column; rate: expected
    count a word; weights: one row a category of intercept, features, then the
    log odds of the categories before."""

    names: tuple[str, ...]
    vocabulary: dict[str, int]
    rate: np.ndarray
    weights: tuple[np.ndarray, ...]

    def values(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return surprise(counts, words, self.rate)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column a category."""
        odds: list[np.ndarray] = []
        for w in self.weights:
            odds.append(_logit(w, np.column_stack([x, *odds])))
        return 1 / (1 + np.exp(-np.column_stack(odds)))


def surprise(counts: np.ndarray, words: np.ndarray, rate: np.ndarray) -> np.ndarray:
    expected = words[:, None] * rate[None, :]
    return np.clip((counts - expected) / np.sqrt(expected + 0.25), 0, 6)


def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(w[0] + x @ w[1:], -15, 15)


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 3.0, steps: int = 10, odds: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression with an L2 penalty, by Newton's method. odds: further
    columns. Gradient and Hessian are sums over blocks of rows, so that no copy of
    the whole of x is made."""
    n, width = len(x), 1 + x.shape[1] + (0 if odds is None else odds.shape[1])
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(width)
    w[0] = np.log(rate / (1 - rate))
    if y.min(initial=1) == y.max(initial=0):
        return w
    ridge = np.full(width, penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        h, g = np.zeros((width, width)), -ridge * w
        for at in range(0, n, _ROWS):
            rows = slice(at, at + _ROWS)
            z = np.column_stack([np.ones(len(y[rows])), x[rows], *([] if odds is None else [odds[rows]])])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -15, 15)))
            h += (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z
            g += z.T @ (y[rows] - p)
        h[np.diag_indices(width)] += ridge
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-2:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, ...]:
    """labels: one column a category. folds: the fold of each row."""
    weights, odds = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        weights.append(fit_linear(x, labels[:, k], odds=odds))
        held = np.zeros(len(x))
        for f in np.unique(folds):
            out = folds == f
            w = fit_linear(x[~out], labels[~out, k], odds=odds[~out])
            held[out] = np.clip(w[0] + x[out] @ w[1 : 1 + x.shape[1]] + odds[out] @ w[1 + x.shape[1] :], -15, 15)
        odds = np.column_stack([odds, held])
    return tuple(weights)


def _count(text: str) -> tuple[Counter, int]:
    words = Counter(_WORD.findall(text.lower()))
    found: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            found[f] += n
    return found, sum(words.values())


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], text: str = "text", doc_id: str = "doc_id", sample: int = 12_000, features: int = 300, folds: int = 3) -> Chain:
    """categories: name to a 0/1 column over labels, in the order of the chain."""
    names = tuple(categories)
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # at most `sample` ids go out and, staged, at most `sample` rows come back, however often an id repeats
    rows = stage(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text")), "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per feature: negative and positive documents of each category that have
        it once or more, twice or more; occurrences among all-negative rows."""
        for batch in batches:
            y = np.column_stack([batch.column(n).to_numpy() for n in names]).astype(bool)
            known: dict[str, int] = {}
            ids, counts, sizes = [], [], []
            for t in batch.column("text").to_pylist():
                found, words = _count(t)
                found[""] = words
                ids += [known.setdefault(f, len(known)) for f in found]
                counts += found.values()
                sizes.append(len(found))
            at, n, y = np.array(ids, np.int64), np.array(counts, np.int64), np.repeat(y, sizes, axis=0)
            clean = ~y.any(axis=1)
            marks = [clean * n, clean, *(m & (n > k) for c in y.T for k in (0, 1) for m in (~c, c))]
            sums = np.stack([np.bincount(at, weights=m, minlength=len(known)) for m in marks], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(sums), pa.list_(pa.int64()))], ["feature", "n"])

    width = 2 + 4 * len(names)
    sums = rows.mapInArrow(tally, "feature string, n array<long>").groupBy("feature").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(width)])
    sums = sums.filter("n2 + n3 >= 5 or feature = ''")
    totals = rows.groupBy().agg(*[f(F.col(n)).cast("double") for n in names for f in (F.count, F.sum)]).first()
    score = F.lit(0.0)
    for k in range(len(names)):
        count, positive = totals[2 * k] or 0.0, totals[2 * k + 1] or 0.0
        for at in (2 + 4 * k, 4 + 4 * k):
            a, b = F.col(f"n{at + 1}").cast("double"), F.col(f"n{at}").cast("double")
            gap = a * count - (a + b) * positive  # chi square of a 2 x 2 table, for features of the positive side
            base = (a + b) * (F.lit(count) - a - b) * positive * (count - positive)
            score = F.greatest(score, F.when((gap > 0) & (base > 0), count * gap * gap / base).otherwise(0.0))
    top = sums.filter("feature <> ''").withColumn("score", score).orderBy(F.desc("score"), "feature").limit(features).collect()
    total_words = next(iter(sums.filter("feature = ''").collect()), None)
    vocabulary = {r["feature"]: i for i, r in enumerate(top)}
    rate = np.array([(r["n0"] + 0.0) / max(1, total_words["n0"] if total_words else 1) for r in top])

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, words = count_matrix(batch.column("text").to_pylist(), vocabulary, {})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(n) for n in names), pa.array([c.astype("<i4").tobytes() for c in counts], pa.binary()), pa.array(words, pa.int64())], ["doc_id", *names, "counts", "words"])

    table = rows.mapInArrow(design, "doc_id long, " + ", ".join(f"`{n}` int" for n in names) + ", counts binary, words long").toArrow().sort_by("doc_id")  # at most `sample` x `features`
    words, at = table.column("words").to_numpy().astype(np.float32), 0
    x = np.empty((len(table), len(vocabulary)), np.float32)
    for chunk in table.column("counts").chunks:  # no second copy of the whole
        for block in (chunk.slice(i, _ROWS) for i in range(0, len(chunk), _ROWS)):
            counts = np.frombuffer(b"".join(block.to_pylist()), "<i4").astype(np.float32).reshape(len(block), len(vocabulary))
            x[at : at + len(block)] = surprise(counts, words[at : at + len(block)], rate.astype(np.float32))
            at += len(block)
    y = np.column_stack([table.column(n).to_numpy() for n in names]).astype(np.float64).reshape(len(table), len(names))
    ids = table.column("doc_id").to_pylist()
    del table
    fold = np.array([hash_fold(i, folds) for i in ids], np.int64)
    chain = Chain(names, vocabulary, rate, fit_chain(x, y, fold))
    del x, y
    trim()  # the driver goes on to other work
    return chain


def hash_fold(key: int, folds: int) -> int:
    return (key * 2654435761 >> 7) % folds


def count_matrix(texts: list[str | None], vocabulary: dict[str, int], memo: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and number of words of each text."""
    counts, words = np.zeros((len(texts), len(vocabulary)), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = _WORD.findall((t or "").lower())
        words[i] = len(found)
        hits: list[int] = []
        for w in found:
            got = memo.get(w)
            if got is None:
                if len(memo) > _CACHE:
                    memo.clear()
                got = memo[w] = tuple(vocabulary[f] for f in word_features(w) if f in vocabulary)
            if got:
                hits += got
        if hits:
            counts[i] = np.bincount(hits, minlength=len(vocabulary))
    return counts, words


def classify(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.4) -> DataFrame:
    """One row per input row: row (the input row), p_<category> each, and reject:
    the last category reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    packed, at = pack(docs), docs.columns.index(text)
    added = [f"p_{n}" for n in chain.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for batch in blocks(iter([whole.append_column("text", whole.column("row").field(at))]), "text", 4 << 20):
                c = model.value
                counts, words = count_matrix(batch.column("text").to_pylist(), c.vocabulary, memo)
                p = c.predict(c.values(counts, words))
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["row", *added])

    schema = T.StructType([packed.schema["row"], *[T.StructField(n, T.DoubleType()) for n in added]])
    return packed.mapInArrow(run, schema).withColumn("reject", F.col(added[-1]) >= threshold)


#: The chain for a label table with quality and toxic: poor quality first.
CATEGORIES = {"low_quality": lambda: F.lit(1) - F.col("quality"), "toxic": lambda: F.col("toxic")}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, train(docs, labels, {n: c() for n, c in CATEGORIES.items()}))


def decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select(F.col("row.doc_id").alias("doc_id"), "p_low_quality", "p_toxic", F.col("reject").alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns."""
    return scored(docs, labels).filter("not reject").select("row.*")
