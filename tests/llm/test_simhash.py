"""SimHash against all pairs, with hot groups and both ways of posting lists."""

import re

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash


def brute_fp(text, size=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, d in enumerate(ids)}


def check(spark, rows, **more):
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string, a int"), **more).collect()
    fps = [brute_fp(t) for _, t, *_ in rows]
    want = brute_components([r[0] for r in rows], fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for (d, *_), f in zip(rows, fps, strict=True)}
    assert len(got) == len(rows)


@pytest.mark.parametrize("list_max", [simhash.LIST_MAX, 4])
def test_against_all_pairs(spark, list_max):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = base[i % 12 if i % 3 else 0].split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(9)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "ONE  Two"), (205, "é É ü Ü ß"), (206, "a " * 3000)]
    check(spark, [(*r, "clash", 1) for r in rows], list_max=list_max)


def test_empty_and_repeated(spark):
    check(spark, [(7, "a b c d e", "x", 1), (3, "a b c d e", "x", 1)])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = simhash.near_duplicates(spark.createDataFrame([(1, "p q"), (1, "p q"), (None, "p q")], "doc_id long, text string")).collect()
    assert [r.component_id for r in twice] == [1, 1, 1]


@pytest.mark.parametrize("list_max", [10**6, 2])
def test_links_lose_nothing(spark, list_max):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            x = int(s)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), list_max=list_max))
    roots = {f: f for f in fps} | {r.node: r.root for r in got.collect()}
    want = brute_components(fps, [f & (2**64 - 1) for f in fps])
    assert roots == want


def test_chain_settles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[1001] == 1000


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_hot_lists_lose_nothing_below_four(spark, distance):
    rng = np.random.default_rng(7)
    fps = set()
    for s in rng.integers(0, 2**62, 12):
        for _ in range(5):
            x = int(s)
            for b in rng.choice(62, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance, 2))
    roots = {f: f for f in fps} | {r.node: r.root for r in got.collect()}
    assert roots == brute_components(fps, fps, distance)
