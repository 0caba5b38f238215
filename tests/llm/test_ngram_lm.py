"""The language model against a plain implementation with dictionaries."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from spanloom.llm import ngram_lm


def plain(rows, folds=10):
    docs = []
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        held = zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0
        docs.append((i, held, re.findall(r"[^\x20\x09-\x0D]+", low) + ["</end>"]))
    pairs, words = Counter(), Counter()
    for _, held, ws in docs:
        if not held:
            words.update(ws)
            pairs.update(zip(["<begin>", *ws], ws))
    n, v = sum(words.values()), len(words)
    cont, total, kinds = Counter(), Counter(), defaultdict(Counter)
    for (h, w), c in pairs.items():
        cont[w] += 1
        total[h] += c
        kinds[h][min(c, 3)] += 1
    of = lambda counts: [sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)]
    dp, dw = ngram_lm.discounts(of(pairs)), ngram_lm.discounts(of(cont))
    big = sum(cont.values())
    left = sum(dw[min(c, 3)] for c in cont.values())

    def lower(w):
        return (max(cont[w] - dw[min(cont[w], 3)], 0) + left / (v + 1)) / big if big else 1 / (v + 1)

    def p(h, w):
        if not total[h]:
            return lower(w)
        c = pairs[h, w]
        return max(c - dp[min(c, 3)], 0) / total[h] + sum(dp[k] * m for k, m in kinds[h].items()) / total[h] * lower(w)

    out = []
    for i, held, ws in docs:
        base = sum(log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, held, len(ws), sum(words[w] > 0 for w in ws), n, base, sum(log10(p(h, w)) for h, w in zip(["<begin>", *ws], ws))))
    vocabulary = [*words, "<never seen>"]
    for h in ("<begin>", *list(words)[:3], "nothing"):
        assert sum(p(h, w) for w in vocabulary) == pytest.approx(1)
    return out


def check(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 300)
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, block int, keys string").repartition(3)
    got = sorted(map(tuple, ngram_lm.score_documents(docs).collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"W{x}" for x in range(40)]
    weights = 1 / np.arange(1, 41)
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum()))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "\n\t "), (503, "never seen words é É"), (504, "A a " * 400), (1, "repeated id"), (None, "no id"), (505, "x\x1cy\xa0z")]
    check(spark, rows, monkeypatch)


def test_small(spark, monkeypatch):
    check(spark, [(1, "one")], monkeypatch)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(spark, [(held, "only held out")], monkeypatch)
    assert ngram_lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keys_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert (ngram_lm.unpack_keys(ngram_lm.pack_keys(keys)) == keys).all()
