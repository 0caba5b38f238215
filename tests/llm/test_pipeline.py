"""The pipeline against brute force over its own stages' inputs."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import toxicity
from spanloom.llm.pii import ANY
from tests.llm.test_near_copies import brute as brute_jaccard
from tests.llm.test_simhash import brute_components, brute_fp


def make(spark, tmp_path):
    rng = np.random.default_rng(6)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "ne", "po"]
    text = lambda n: " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        t, bad = text(int(rng.integers(5, 90))), i % 5 == 0
        labels.append((i, 1, int(bad)))
        rows.append((i, t + (" scum idiot scum" if bad else " mail a.b@c.example.org" if i % 7 == 0 else ""), "en", "s", 0))
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 1), "en", "s", 0) for i in range(1, 60, 3)]
    long = text(900)
    rows += [(300 + i, long + f" end{i}", "en", "t", 0) for i in range(6)] + [(400, None, None, None, None), (401, "", "en", "s", 0), (1, rows[1][1], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_and_run(spark, tmp_path):
    import regex

    d = make(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{d}/{name}")
        seen[name] = (before, docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns
    before, after = seen["toxicity"]
    rejected = {r.doc_id for r in toxicity.decisions(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect() if r.toxic}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == rejected >= {i for i in range(0, 160, 5)} and not rejected & {i for i in range(160) if i % 5}
    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        key = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(i for _, i in best.values())
    before, after = seen["simhash_near_dedup"]
    groups = brute_components([r.doc_id for r in before], [brute_fp(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))
    before, after = seen["pii_surrogates"]
    old, new = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
    assert old.keys() == new.keys() and any(old[i].text != new[i].text for i in old)
    for i, r in old.items():
        cut = regex.compile(ANY.replace("IsCyrillic", "Cyrillic"))
        assert (new[i].text == r.text) == (not cut.search(r.text or "")) and (not new[i].text or new[i].n_chars == len(new[i].text))
    before, after = seen["best_fit_packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    whole = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in after)


def test_near_dedup_keeps_one_of_each_group_by_jaccard(spark):
    """The stage against exact five-word Jaccard of all pairs, with texts that the
    fingerprints of op8 would not link."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(40, 200)))]
        rows.append((10 * i, " ".join(words)))
        for j in (1, 2):
            other = list(words)
            for at in rng.choice(len(words), int(len(words) * rng.uniform(0, 0.05)), replace=False):
                other[at] = f"x{rng.integers(10**6)}"
            rows.append((10 * i + j, " ".join(other)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (2004, "one three")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    want = brute_jaccard(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and 40 < len(set(want.values())) < 110
    linked = {(a, b) for a, b in want.items() if a != b}
    prints = {i: brute_fp(t) for i, t in rows}
    assert any((prints[a] ^ prints[b]).bit_count() > 4 for a, b in linked)


def test_near_dedup_links_by_simhash_too(spark):
    """Texts of equal or close SimHash fingerprints whose five-word Jaccard is far
    below 0.8: a sentence said over and over votes alone, whatever stands around it."""
    rng = np.random.default_rng(9)
    said = "one sentence stands here again and again "
    rows = [(i, said * 60 + " ".join(f"t{i}x{x}" for x in range(30))) for i in range(6)]
    rows += [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 80))) for i in range(20)]
    rows += [(None, said * 60 + "no id")]
    prints = {i: brute_fp(t) for i, t in rows}
    assert {(prints[0] ^ prints[i]).bit_count() <= 4 for i in range(6)} == {True} and len(set(brute_jaccard(rows[:-1]).values())) == 26
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    groups = brute_components([i for i, _ in rows[:-1]], [prints[i] for i, _ in rows[:-1]])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(groups.values())) and len(set(groups.values())) == 21


def test_stages_on_odd_input(spark, tmp_path):
    """Columns that clash, nulls everywhere, ties and repeats, a very long text, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, found int, component_id long, keep_id string, length int, ids string"
    more = ("r", 1, 2, "k", 3, "i")
    rows = [(1, "Call +1 (386) 555-3733 now", "en", "s", 26), (2, "call +1 (386) 555-3733  now", "en", "s", 27), (2, "Call +1 (386) 555-3733 now ", None, None, None), (None, "no id", "en", None, 5), (3, None, "en", "s", None)]
    rows += [(4, "", "en", "s", 0), (5, "long words here " * 60_000, "en", "s", 960_000), (6, "tie a b", "en", "s", 7), (6, "tie a b", "en", "s", 7), (7, "tie ab", "en", "s", 6)]
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, *more) for r in rows], schema)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = step(spark, docs, str(tmp_path)).collect()
        got = sorted(((r.doc_id or 0), "" if name == "best_fit_packing" else r.text or "") for r in out)
        if name != "best_fit_packing":
            assert out[0].asDict().keys() == set(docs.columns) and all((r.row, r.found, r.ids) == ("r", 1, "i") for r in out), name
        if name == "toxicity":
            assert got == sorted(((r[0] or 0), r[1] or "") for r in rows)
        elif name == "exact_dedup":  # the longest of equal texts, then the smallest id
            assert sorted(i for i, _ in got) == [0, 2, 2, 3, 5, 6]
        elif name == "simhash_near_dedup":  # null ids, and rows of the kept id, stay
            assert {i for i, _ in got} >= {0, 1, 3, 5} and len(got) < len(rows)
        elif name == "pii_surrogates":
            assert len(out) == len(rows) and not any("555-3733" in t for _, t in got) and {r.n_chars for r in out if r.text and r.text.startswith("long")} == {960_000}
        else:
            assert {r.doc_id for r in out} == {r[0] for r in rows} and sum(r.length for r in out if r.doc_id == 5) == 180_001
