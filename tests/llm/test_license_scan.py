"""License scans against a plain scan, with edits and hostile texts."""

import re

import numpy as np

from spanloom.llm import license_scan as ls
from spanloom.llm.license_texts import TEMPLATES


def plain(text):
    words = split(text or "")
    places, labels = [], set()
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def split(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def grams_of(notice, k):
    t = split(notice)
    return {j: tuple(t[j : j + k]) for j in range(len(t) - k + 1) if set(t[j : j + k]) - ls.COMMON}


def votes(text, k=3, drift=2, coverage=0.75, templates=TEMPLATES):
    words, found, best = split(text or ""), set(), 0.0
    grams = [grams_of(notice, k) for _, notice in templates]
    for (label, notice), own in zip(templates, grams, strict=True):
        t, voting, n = split(notice), list(own), len(own)
        apart = [{j for j, g in own.items() if g not in other.values()} for (rival, _), other in zip(templates, grams, strict=True) if rival != label]
        apart = [a for a in apart if a and len(a) <= n / 2]
        hits = {}
        for i in range(len(words) - k + 1):
            for j in voting:
                if words[i : i + k] == t[j : j + k]:
                    hits.setdefault(i - j, []).append((i, j))
        spans, last = [], None
        for d in sorted(hits):
            if last is None or d - last > drift:
                spans.append([])
            spans[-1] += hits[d]
            last = d
        for s in spans:
            covered = {j for _, j in s}
            share = len(covered) / n
            if share >= coverage and all(len(covered & a) >= coverage * len(a) for a in apart) and max(i for i, _ in s) + k - 1 - min(i for i, _ in s) < 2 * (n + k):
                found.add(label)
                best = max(best, share)
    return found, best


TEXTS = [
    None, "", "...", "Released under the MIT License.", "x Licensed under CC BY-NC 4.0. y", "cc by cc by", "CC  BY, cc-by", "the GNU General Public\nLicense general public license",
    "ALL RIGHTS RESERVED all rights", "rights reserved all", "licensed under the GNU General Public License, version 3.", "This program is free software: you can really redistribute it and/or modify it under the terms of the GNU General Public License",
    "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and documentation files", "Licensed under the Apache License, Version 2.0. " * 50, "w " * 30000 + "released under the mit license",
    "É cc by ü", "ccby", "cc1 by", "Licensed under the MIT License", "K all rights reserved", "under the mit license the mit license", "it's cc 'by' & general/public/license",
]


def test_scans(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(3, "cc by", "c", 1), (None, "all rights reserved", "c", 1)]
    got = ls.decisions(spark.createDataFrame(rows, "doc_id long, text string, words string, uid int")).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, *_ in rows:
        n, base, first, last, labels = plain(t)
        more, best = votes(t)
        want.append((i, n, base, first, last, labels, ",".join(sorted({x for x in labels.split(",") if x} | more)), 1.0 if base else best))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ls.decisions(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_meet_every_gram():
    assert all(set(g.split()) & set(ls.anchors(3)) for *_, g, _ in ls.template_grams(3))
    assert all(re.fullmatch(r"[a-z0-9 ]+", g) for *_, g, _ in ls.template_grams(3))


def test_library(spark):
    """Whole texts and identifiers give their own label; near ones do not."""
    cases = [(label, text) for label, text in TEMPLATES] + [("gpl-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA-4.0"), ("", "SPDX-License-Identifier: LicenseRef-Own"), ("", "the license identifier of this")]
    docs = spark.createDataFrame([(i, f"before it {t} behind") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    for r in ls.decisions(docs).collect():
        label, text = cases[r.doc_id]
        more, best = votes(text)
        assert set(filter(None, r.labels.split(","))) == more | set(filter(None, r.base_labels.split(",")))
        assert (label in more) if label else not more, (label, r.labels)
    for a in ("bsd-2-clause", "cc-by-nc", "apache-2.0"):  # variants keep apart
        others = {x for label, t in TEMPLATES if label == a for x in votes(t)[0]}
        assert not others & {"gpl-3.0", "cc-by-sa", "bsd-3-clause"}, (a, others)


def test_own_templates_of_any_length(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words, 700))
    templates = (("long", long), ("short", "w1 w2 w3 w4"))
    cut = long.split()
    texts = [long, " ".join(cut[:200] + ["x"] + cut[200:]), " ".join(cut[:600]), " ".join(cut[:400]), "w1 w2 w3 w4", " ".join(cut[::-1]), long + " w9 " + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    staged, spans = ls.scan(docs, templates=templates)
    got = {}
    for r in staged.select("uid", "doc_id").join(spans, "uid").collect():
        got.setdefault(r.doc_id, set()).add(r.label)
    assert {i: votes(t, templates=templates)[0] for i, t in enumerate(texts)} == {i: got.get(i, set()) for i in range(len(texts))}
    assert [got.get(i, set()) for i in range(6)] == [{"long"}, {"long"}, {"long"}, set(), {"short"}, set()]


_TERMS = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{1} either version {3} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."


def test_headers_that_differ_in_a_word(spark):
    """GNU headers of every name and version give their own label alone (`gpl` is the base one)."""
    cases = [
        (_TERMS.format("program", ";", "", "2"), {"gpl", "gpl-2.0"}),
        (_TERMS.format("program", ":", "", "3"), {"gpl", "gpl-3.0"}),
        (_TERMS.format("library", ";", "Lesser ", "2.1"), {"gpl", "lgpl", "lgpl-2.1"}),
        (_TERMS.format("program", ":", "Lesser ", "3"), {"gpl", "lgpl", "lgpl-3.0"}),
        (_TERMS.format("program", ":", "Affero ", "3"), {"gpl", "agpl", "agpl-3.0"}),
        (_TERMS.format("library", ";", "Library ", "2"), {"gpl", "lgpl-2.0"}),
        ("licensed under the GNU General Public License, version 2.", {"gpl", "gpl-2.0"}),
        ("licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
        ("under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", {"gpl", "gpl-2.0"}),
        ("licensed under the GNU Affero General Public License", {"gpl", "agpl"}),
        ("licensed under the GNU Lesser General Public License", {"gpl"}),
        ("licensed under CC BY-NC 4.0 and all", {"cc-by", "cc-by-nc"}),
    ]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in ls.decisions(docs).collect()}
    for i, (text, labels) in enumerate(cases):
        assert got[i] == labels, (text[:90], got[i])
