"""Exact dedup against a dictionary, its codes, and odd tables."""

import hashlib

import numpy as np
import pytest

from spanloom.llm import exact_dedup

WHITE = " \t\n\x0b\x0c\r"


def bare(text):
    return "".join(c for c in text or "" if c not in WHITE)


def brute(rows):
    """doc_id to (keep_id, group_size, kept, sha) for rows with distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    keep = {k: min(g)[1] for k, g in groups.items()}
    return {i: (keep[bare(t)], len(groups[bare(t)]), keep[bare(t)] == i, hashlib.sha256(bare(t).encode()).hexdigest()) for i, t in rows}


def check(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = exact_dedup.decisions(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
@pytest.mark.parametrize("top", [1, 9, 2**20, 2**48 - 1])
def test_codes_come_back(n, top):
    values = np.unique(np.random.default_rng(n).integers(0, top + 1, n))
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values), len(values)) == values).all()


def test_codes_are_small():
    values = np.unique(np.random.default_rng(0).integers(0, 2**48, 20_000))
    assert len(exact_dedup.rice_encode(values)) < 5 * len(values)


def test_against_dictionary(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 30)))) for _ in range(60)]
    # a third of all rows are one text, spaced in different ways
    rows = [(i, base[0].replace(" ", WHITE[i % 6] * (1 + i % 4))) for i in range(150)]
    rows += [(150 + i, base[int(rng.integers(1, 60))] + WHITE[i % 6] * (i % 3)) for i in range(300)]
    rows += [(500, None), (501, ""), (502, " \t\r"), (503, "é ü"), (504, "éü"), (505, "éü"), (506, " "), (507, "x y"), (508, "xy")]
    rows += [(510, "long " * 300_000), (511, "long" * 300_000), (-4, "Case"), (-5, "case")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(5, "one")], [(5, None)], [(9, "a b"), (2, "a  b"), (7, "ab ")], [(9, "a b"), (2, "a b")]])
def test_few_rows_and_ties(spark, rows):
    check(spark, rows, parts=2)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same")] * 4 + [(None, "same"), (None, "alone"), (None, "pair"), (None, "pair"), (8, "longer  same text"), (3, "longer same text")]
    got = exact_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    kept = [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept]
    order = lambda xs: sorted(xs, key=str)
    assert order(kept) == order([(1, 1, 5), (None, None, 1), (None, None, 2), (8, 8, 2)])
    assert all(r.group_size == 5 for r in got if r.keep_id == 1)


def test_empty_table_and_clashing_columns(spark):
    assert exact_dedup.decisions(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    names = ["chunk", "run", "pos", "slot", "fp", "local", "chars", "sha", "row", "maps", "body", "best", "kept", "keep_id", "group_size", "suspect", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, *[k for k in range(len(names))]) for i, t in [(1, "x"), (2, "x "), (3, "y"), (4, None)]], schema)
    out = exact_dedup.deduplicate(docs)
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [2, 3, 4]
    assert all(list(r[2:]) == list(range(len(names))) for r in out.collect())


def test_runs_cut_into_many_batches(spark):
    """Copies meet across batches of one task and across tasks alike."""
    rows = [(i, f"t{i % 37}" + " " * (i % 5)) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        check(spark, rows, parts=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
