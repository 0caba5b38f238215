"""Near copies against exact Jaccard of all pairs."""

import numpy as np

from spanloom.llm import near_copies
from tests.llm.test_simhash import brute_components


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    return brute_components([d for d, _ in rows], [r << 8 for r in root], 0)


def test_pairs_of_0_8_are_found_and_others_stay(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(30, 300)))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            other = list(words)
            for at in rng.choice(len(words), int(len(words) * rng.uniform(0, 0.045)), replace=False):
                other[at] = f"x{rng.integers(10**6)}"
            rows.append((10 * i + j, " ".join(other)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "one  two"), (1004, "one three")]
    want = brute(rows)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
    assert 65 < len(set(want.values())) < 240
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_copies.keep_one(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "p q"), (1, "p q"), (None, "p q"), (3, "p q"), (4, "r")]
    assert sorted((r.doc_id or 0) for r in near_copies.keep_one(spark.createDataFrame(rows, schema)).collect()) == [0, 1, 1, 4]
