"""Merkle manifest against a plain recursive version, proofs, tampering and SQL."""

import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, lo int, row int, path string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """The root, and for each node the siblings of each step as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        tampered = text and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        changed = "".join(c.lower() if c.isascii() else c for c in text) if tampered else text
        entry = (doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), leaf_of(doc_id, source, lang, n_chars, changed), doc_id)
        trees.setdefault(lang, []).append(entry)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in order:
        trees[lang].sort(key=lambda e: e[:3])
        subs[lang] = climb([e[2] for e in trees[lang]])
    if not order:
        return []
    root, tops = climb([subs[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        for e, path in zip(trees[lang], subs[lang][1], strict=True):
            got = e[3]
            for left, right in path + top:
                got = h(left, got, right)
            out.append((e[4], e[2], subs[lang][0], root, h(*[x for s in path + top for x in s]), got, got == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.verified(docs).collect()), key=str)


def made(n, langs, seed):
    rng = np.random.default_rng(seed)
    return [(int(i) * 3, f"Text {i} Ünï " * int(rng.integers(0, 4)), langs[int(rng.integers(len(langs)))], "s", int(rng.integers(9))) for i in rng.permutation(n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (8, ["en"]), (9, ["en", None]), (130, ["en", "de", None, "", "zz"]), (700, ["en"] * 9 + [f"l{i}" for i in range(70)])])
def test_as_brute_force(spark, n, langs):
    rows = made(n, langs, n)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "Null id", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "", 0), (3, "Long Word " * 200_000, "en", "s", 7)]
    rows += [(4, "Same", "en", "s", 4)] * 9 + [(4, "Other", "en", "s", 4), (5, "Café ÀÉ A", "ü", "s", 9), (6, "a:b-1:", "=", "2:x", -3)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == len(rows)
    assert {r[6] for r in got if r[0] is None} == {True}


def test_empty_and_nodes(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.verified(docs).collect() == []
    rows = made(100, ["a", "b"], 3)
    m = merkle.manifest(merkle.leaves_of(spark.createDataFrame([(*r, "x", "y", 1, 2, "z") for r in rows], SCHEMA)))
    nodes = m.nodes().collect()
    assert {(r.part, r.tree) for r in nodes} == {("tree", "=a"), ("tree", "=b"), ("root", "")}
    for r in nodes:  # intervals nest: each lies in exactly one of the level above
        above = [x for x in nodes if (x.part, x.tree, x.level) == (r.part, r.tree, r.level + 1)]
        assert not above or sum(x.lo <= r.lo and r.hi <= x.hi for x in above) == 1
    assert merkle.proofs(m).filter(merkle.fold(F.col("digest"), F.col("path")) != F.col("root")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 70])
def test_sql(spark, n):
    rows = made(n, ["en", None, "de"], 5) + [(None, None, "en", None, None)] * (n > 1)
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64", "text": "string", "lang": "string", "source": "string"}))
    assert sorted(db.sql(merkle.ORACLE).fetchall(), key=str) == brute(rows)
