"""The classifier chain: held-out accuracy, clean rows, and odd input."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import toxicity


def corpus(n=700, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "ne", "po", "vi", "da"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(2, 5))))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(int(rng.integers(20, 200)))]
        toxic, poor = int(rng.random() < 0.25), int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                words[int(rng.integers(len(words)))] = rng.choice(["Idiot", "scum,", "grolm" + word()])
        if poor:
            words += ["click"] * 8
        docs.append((i, " ".join(words), "p", 0.5))
        labels.append((i, 1 - poor, toxic))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    more = [(5000, None, "p", 0.1), (5001, "", "p", 0.1), (5002, "kalo misa " * 20000, "p", 0.1), (None, "idiot scum idiot scum", "p", 0.1), (3, docs[3][1], "again", 0.2)]
    table = spark.createDataFrame(docs + more, "doc_id long, text string, p_toxic string, reject double")
    marks = spark.createDataFrame([*labels[:450], (7000, None, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(table, marks, {n: c() for n, c in toxicity.CATEGORIES.items()})
    assert chain.names == ("low_quality", "toxic") and len(chain.weights[1]) == len(chain.weights[0]) + 1
    got = toxicity.classify(table, chain).select("row.doc_id", F.col("row.p_toxic").alias("own"), "p_low_quality", "p_toxic", "reject").collect()
    assert len(got) == len(docs) + len(more)
    test = [(r.reject, labels[r.doc_id][2], r.p_low_quality >= 0.5, 1 - labels[r.doc_id][1]) for r in got if r.doc_id is not None and 450 <= r.doc_id < 700]
    assert sum(a == b for a, b, *_ in test) / len(test) > 0.95
    assert sum(a and not b for a, b, *_ in test) <= 2
    assert sum(a == b for *_, a, b in test) / len(test) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[None].reject and not by[5000].reject and not by[5001].reject and not by[5002].reject
    clean = toxicity.classify(table, chain).filter("not reject").select("row.*")
    assert clean.columns == table.columns


def test_degenerate(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(6)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert not any(r.toxic and labels is one for r in toxicity.decisions(docs, labels).collect())
    assert toxicity.decisions(docs.limit(0), one).collect() == []


def test_chain_uses_out_of_fold_odds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] > 0).astype(float)
    y = np.column_stack([first, first])
    weights = toxicity.fit_chain(x, y, np.arange(400) % 4)
    assert len(weights[1]) == 5 and weights[1][4] > 0


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    docs, labels = corpus(120)
    seen = []
    real = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda x, y, f: (seen.append(len(x)), real(x, y, f))[1])
    table = spark.createDataFrame(docs + [docs[0]] * 400 + [(0, "another text", "p", 0.5)], "doc_id long, text string, p_toxic string, reject double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    categories = {n: c() for n, c in toxicity.CATEGORIES.items()}
    toxicity.train(table, marks, categories)
    toxicity.train(table, marks, categories, sample=50)
    assert seen == [120, 50]


def test_against_a_plain_version(spark):
    """Features, rates, out-of-fold chain and scores worked out again, row by row."""
    import re

    docs, labels = corpus(260, 3)
    docs += [(900, None, "p", 0.1), (901, "Idiot " * 300, "p", 0.1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, p_toxic string, reject double")
    chain = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {n: c() for n, c in toxicity.CATEGORIES.items()}, features=40)
    y = {i: (1 - q, t) for i, q, t in labels}

    def counts(text):
        out = {}
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for f in {w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k)}:
                out[f] = out.get(f, 0) + 1
        return out, len(re.findall(r"[^\W\d_]+", (text or "").lower()))

    told = {i: counts(t) for i, t, *_ in docs}
    known = sorted(y)
    clean_words = sum(told[i][1] for i in known if not any(y[i]))
    score = {}
    for f in {f for i in known for f in told[i][0]}:
        if sum(f in told[i][0] for i in known) < 5:
            continue
        best = 0.0
        for k in (0, 1):
            for least in (1, 2):
                has, pos = [told[i][0].get(f, 0) >= least for i in known], [y[i][k] == 1 for i in known]
                n, a, b = len(known), sum(h and p for h, p in zip(has, pos)), sum(h and not p for h, p in zip(has, pos))
                p = sum(pos)
                base = (a + b) * (n - a - b) * p * (n - p)
                gap = a * n - (a + b) * p
                best = max(best, n * gap * gap / base if gap > 0 and base > 0 else 0.0)
        score[f] = best
    top = sorted(score, key=lambda f: (-score[f], f.encode()))[:40]
    assert list(chain.vocabulary) == top
    rate = [sum(told[i][0].get(f, 0) for i in known if not any(y[i])) / clean_words for f in top]
    assert np.allclose(chain.rate, rate)

    def values(i):
        found, words = told[i]
        return [min(6.0, max(0.0, (found.get(f, 0) - words * r) / (words * r + 0.25) ** 0.5)) for f, r in zip(top, rate)]

    def fitted(x, t, w):
        """w is the minimum of the penalised loss: its slope is null there."""
        x = np.column_stack([np.ones(len(x)), x])
        slope = x.T @ (t - 1 / (1 + np.exp(-x @ w))) - 3.0 * np.r_[0, w[1:]]
        return np.abs(slope).max() < 0.05

    x = np.array([values(i) for i in known])
    t = np.array([y[i] for i in known], float)
    assert fitted(x, t[:, 0], chain.weights[0])
    folds, odds = np.array([(i * 2654435761 >> 7) % 3 for i in known]), np.zeros(len(known))
    for f in range(3):
        w = toxicity.fit_linear(x[folds != f], t[folds != f, 0])
        assert fitted(x[folds != f], t[folds != f, 0], w)
        odds[folds == f] = np.clip(w[0] + x[folds == f] @ w[1:], -15, 15)
    assert fitted(np.column_stack([x, odds]), t[:, 1], chain.weights[1])
    for r in toxicity.classify(table, chain).select("row.doc_id", "p_low_quality", "p_toxic", "reject").collect():
        v, first = values(r.doc_id), chain.weights[0]
        o = float(np.clip(first[0] + np.dot(v, first[1:]), -15, 15))
        p = 1 / (1 + np.exp(-np.clip(chain.weights[1][0] + np.dot([*v, o], chain.weights[1][1:]), -15, 15)))
        assert abs(r.p_low_quality - 1 / (1 + np.exp(-o))) < 1e-4 and abs(r.p_toxic - p) < 1e-4 and r.reject == (r.p_toxic >= 0.4)


def test_fit_needs_no_copy_of_the_design_matrix():
    """The driver holds the matrix once: fitting takes a small part of it more, and
    the weights are those of the whole at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x = rng.random((9000, 200)).astype(np.float32)
    y = (x[:, 0] + rng.normal(0, 0.3, 9000) > 0.8).astype(np.float64)
    tracemalloc.start()
    w = toxicity.fit_linear(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 9000 * 200 * 8
    z = np.column_stack([np.ones(9000), x.astype(np.float64)])
    gradient = z.T @ (y - 1 / (1 + np.exp(-z @ w))) - 3.0 * np.r_[0, w[1:]]
    assert np.abs(gradient).max() < 0.1
