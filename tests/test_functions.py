"""Expressions on golden cases."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ids, labels, redact, status, text, times
from spanloom.operators import ordered, traces


def values(spark, build, cases, schema):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r[1] for r in rows.select("i", build(*[F.col(c.split()[0]) for c in schema.split(", ")]).alias("v")).orderBy("i").collect()]


def test_clamp(spark):
    cases = [
        ((100, 200, 50, 300), (100, 200)), ((10, 200, 50, 300), (50, 200)), ((100, 400, 50, 300), (100, 300)), ((10, 20, 50, 300), (50, 60)),
        ((10, 40, 50, 60), (50, 60)), ((20, 10, 50, 300), (50, 50)), ((400, 500, 50, 300), (300, 300)), ((10, 20, None, None), (10, 20)),
        ((None, 20, 50, 300), (None, 20)), ((10, None, 50, 300), (50, None)), ((None, None, 50, 300), (None, None)), ((10, 20, 50, None), (50, 60)), ((100, 10, None, None), (10, 10)), ((10, 50, 50, 40), (50, 50)),
    ]
    got = values(spark, lambda a, b, c, d: F.struct(*[x.alias(n) for x, n in zip(times.clamp(a, b, c, d), "se", strict=True)]), [c for c, _ in cases], "a long, b long, c long, d long")
    assert [tuple(g) for g in got] == [w for _, w in cases]


def test_instants(spark):
    cases = [("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05Z",), ("1970-01-01T01:00:00+01:00",), ("1970-01-01T00:00:00.5Z",), ("nonsense",), (None,)]
    base = 1704164645 * 10**9
    assert values(spark, times.rfc3339_nanos, cases, "t string") == [base + 123456789, base, 0, 500_000_000, None, None]
    assert values(spark, times.duration_ms, [(1, 999_999), (2, 1_000_000), (0, 0), (3, None)], "s long, n long") == [1000, 2001, 0, 3000]
    assert values(spark, lambda a, b: times.sane_start(a, b), [(0, 10**12), (10**12, 10**12 + 1)], "a long, b long") == [10**12, 10**12]


@pytest.mark.parametrize(
    ("arg", "want"),
    [
        ("--client_env=GITLAB_TOKEN=abc", "--client_env=GITLAB_TOKEN=***"), ("--action_env=my_password=a=b c", "--action_env=my_password=***"), ("--client_env=GITLAB_TOKEN", "--client_env=GITLAB_TOKEN"),
        ("--define=PATH=/x", "--define=PATH=/x"), ("--define=x=TOKEN", "--define=x=TOKEN"), ("--other=TOKEN=x", "--other=TOKEN=x"), ("--repo_env=Api_Key=", "--repo_env=Api_Key=***"), ("--test_env==x", "--test_env==x"),
        ("x --define=TOKEN=1", "x --define=TOKEN=1"), ("--define=AUTHOR=me\nyou", "--define=AUTHOR=***"),
    ],
)
def test_redact_arg(spark, arg, want):
    assert values(spark, redact.Redactor().arg, [(arg,)], "a string") == [want]
    assert values(spark, redact.Redactor(()).arg, [(arg,)], "a string") == [arg]


def test_redact_text_and_names(spark):
    r = redact.Redactor()
    texts = [("a --define=TOKEN=1\t--define=TOKEN=2\n x--define=TOKEN=3",), ("--define=TOKEN=é|ü end",), ("--define=PATH=1",), ("",)]
    assert values(spark, r.text, texts, "t string") == ["a --define=TOKEN=***\t--define=TOKEN=***\n x--define=TOKEN=3", "--define=TOKEN=*** end", "--define=PATH=1", ""]
    assert values(spark, r.named, [("secretKey", "v"), ("monkey", "v")], "n string, v string") == ["***", "v"]
    df = spark.createDataFrame([(["--define=TOKEN=1"], "t", {"AUTH": "x", "b": "y"}), (["a"], "t", {})], "args array<string>, body string, kv map<string,string>")
    clean, audit = redact.redact_table(df, ("args",), ("body",), ("kv",))
    assert clean.first().asDict() == {"args": ["--define=TOKEN=***"], "body": "t", "kv": {"AUTH": "***", "b": "y"}}
    assert {r["column"]: r.rows_redacted for r in audit.collect()} == {"args": 1, "body": 0, "kv": 1}


def test_text(spark):
    ansi = [("\x1b[31mred\x1b[0m",), ("a\x1b]0;t\x07b",), ("a\x1b]8;;u\x1b\\b",), ("\x1bMx",), ("x\x1b",), ("\x1b[12",), ("plain",), ("\x1b[1;2é\x1b[0mz",)]
    assert values(spark, text.strip_ansi, ansi, "t string") == ["red", "ab", "ab", "x", "x", "", "plain", "0mz"]
    assert values(spark, lambda t: text.truncate_bytes(t, 4, "..."), [("abcd",), ("abcde",), ("abcé",), ("ab€x",), ("a🙂b",), ("🙂🙂",), ("",), (None,)], "t string") == ["abcd", "abcd...", "abc...", "ab...", "a...", "🙂...", "", None]
    assert values(spark, lambda t: text.tail_bytes(t, 4), [("abcd",), ("abcde",), ("éabc",), ("x€ab",), ("🙂abc",)], "t string") == ["abcd", "bcde", "abc", "ab", "abc"]
    assert values(spark, text.short_path, [("a/b/c",), ("c",), ("/c",)], "t string") == ["b/c", "c", "/c"]
    assert values(spark, text.bytestream_display, [("bytestream://h/blobs/x/1",), ("bytestream://h/",), ("bytestream://h",), ("file:///x",)], "t string") == ["blobs/x/1", "bytestream://h/", "bytestream://h", "file:///x"]
    assert values(spark, lambda a: text.argument_after(a, "-c"), [(["-c", "x"],), (["x", "-c"],), (["x"],)], "a array<string>") == ["x", None, None]


def test_labels(spark):
    cases = [("@@//a:b",), ("@repo//a:b",), ("@repo",), ("//a",), ("",), ("@@repo//x",)]
    assert values(spark, labels.shorten_label, cases, "l string") == ["//a:b", "//a:b", "@repo", "//a", "", "repo//x"]
    assert values(spark, labels.normalize_label, cases, "l string") == ["//a:b", "repo//a:b", "repo", "//a", "", "repo//x"]
    spawns = [("CppCompile", ["-o", "o", "-c", "z/y/x.c"], ["a/b/o"], []), ("Link", [], [], ["p/q"]), ("", [], [], []), ("CppCompile", ["-c"], ["a/o"], [])]
    assert values(spark, labels.spawn_name, spawns, "m string, a array<string>, l array<string>, o array<string>") == ["spawn CppCompile y/x.c", "spawn Link p/q", "spawn unknown", "spawn CppCompile a/o"]
    assert values(spark, labels.spawn_candidates, [(["b", "a"], ["a", "", "c"]), ([], [""]), ([], [])], "l array<string>, o array<string>") == [["b", "a", "c"], [""], [""]]
    assert values(spark, labels.test_name, [("@r//t", 1, 2, 3), ("//t", 1, None, None), ("//t", None, 1, 1)], "l string, a int, r int, s int") == ["test //t [attempt=1 run=2 shard=3]", "test //t [attempt=1]", "test //t"]


def test_ids_and_status(spark):
    u = "aaaaaaaa-BBBB-4ccc-dddd-eeeeeeeeeeee"
    assert values(spark, ids.trace_id, [(u,), ("x",)], "u string") == [u.replace("-", "").lower(), "9dd4e461268c8034f5c8564e155c67a6"]
    a, b = values(spark, lambda t, k: ids.span_id(t, "target", k), [("t", "a"), ("t", None)], "t string, k string")
    assert len(a) == len(b) == 16 and a != b
    assert values(spark, lambda c: status.enum_name(c, status.TEST_STATUS), [("2",), ("PASSED",), ("77",), ("odd",), (None,)], "c string") == ["FLAKY", "PASSED", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [tuple(x) for x in values(spark, status.root_status, [(0,), (3,), (None,)], "c int")] == [("Ok", None), ("Error", "exit code 3"), ("Unset", None)]
    assert [tuple(x) for x in values(spark, status.spawn_status, [(0, ""), (1, "x"), (None, None)], "c int, s string")] == [("Unset", None), ("Error", "exit_code=1 status=x"), ("Unset", None)]


def test_tail_and_tree(spark):
    rows = spark.createDataFrame([("a", 1, "xxxé"), ("a", 2, "yyy"), ("b", 1, "short"), ("c", 1, None)], "k string, seq long, text string")
    got = {r.k: (r.tail, r.chunks) for r in ordered.tail(rows, ["k"], "text", ["seq"], 7, "~").collect()}
    assert got == {"a": ("~xéyyy", 2), "b": ("short", 1), "c": ("", 1)}
    assert ordered.tail(rows, ["k"], "text", ["seq"], 6, "~").filter("k = 'a'").first().tail == "~éyyy"
    assert ordered.tail(rows, ["k"], "text", ["seq"], 5, "~").filter("k = 'a'").first().tail == "~yyy"
    spans = spark.createDataFrame([("t", "r", None, 5), ("t", "b", "r", 9), ("t", "a", "r", 7), ("t", "x", "b", 1), ("t", "lost", "gone", 0)], "t string, id string, up string, s long")
    placed = {r.id: (r.depth, r.place) for r in traces.tree_order(spans, "t", "id", "up", "s", "s").collect()}
    assert placed == {"r": (0, 1), "a": (1, 2), "b": (1, 3), "x": (2, 4), "lost": (None, 5)}
    (check,) = traces.trace_check(spans, "t", "id", "up", "id", "r").collect()
    assert (check.span_count, check.has_root, check.dangling) == (5, True, 1)
    assert spark.range(1).select(F.unix_micros(times.to_timestamp(F.lit(1700000000123456999)))).first()[0] == 1700000000123456


def test_trees_of_any_depth(spark):
    """A chain of 100 spans, a wide level, cycles, and what hangs below them."""
    chain = [("deep", f"c{i:03}", f"c{i - 1:03}" if i else None, i) for i in range(101)]
    wide = [("wide", "r", None, 0)] + [("wide", f"k{i}", "r", 50 - i) for i in range(40)] + [("wide", f"g{i}", f"k{i}", 0) for i in range(40)]
    rings = [("ring", "r", None, 9), ("ring", "a", "c", 1), ("ring", "b", "a", 2), ("ring", "c", "b", 3), ("ring", "under", "b", 4), ("ring", "self", "self", 5), ("ring", "lost", "gone", 6), ("ring", "below", "lost", 7), ("ring", "kid", "r", 8)]
    odd = [("odd", "r", None, -5), ("odd", "x", "r", -9), ("odd", "x", "r", -9), ("odd", None, "r", 1), (None, "y", None, 1)]
    spans = spark.createDataFrame(chain + wide + rings + odd, "t string, id string, up string, s long")
    got = {(r.t, r.id): (r.depth, r.place) for r in traces.tree_order(spans, "t", "id", "up", "s", "s").collect()}
    assert [got["deep", f"c{i:03}"] for i in range(101)] == [(i, i + 1) for i in range(101)]
    order = ["r"] + [x for i in reversed(range(40)) for x in (f"k{i}", f"g{i}")]
    assert [got["wide", i][1] for i in order] == list(range(1, 82)) and got["wide", "g7"][0] == 2
    assert [got["ring", i] for i in ("r", "kid", "a", "b", "c", "under", "self", "lost", "below")] == [(0, 1), (1, 2), *[(None, n) for n in range(3, 10)]]
    twice = traces.tree_order(spans, "t", "id", "up", "s", "s").filter("id = 'x'").collect()
    assert got["odd", "r"] == (0, 1) and sorted((r.depth, r.place) for r in twice) == [(1, 2), (1, 3)] and got["odd", None] == got[None, "y"] == (None, None)
    assert traces.tree_order(spans.limit(0), "t", "id", "up", "s", "s").collect() == []


def test_closure_depths_and_modes(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("c", "b"), ("d", "e")], "p string, c string")
    roots = spark.createDataFrame([("a",), ("a",), ("e",), ("none",)], "r string")
    got = sorted(map(tuple, traces.closure(edges, roots, "p", "c", "r").collect()))
    assert got == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("e", "e", 0), ("none", "none", 0)]
    rows = spark.createDataFrame([(k, i) for k in "xyz" for i in range(6)], "k string, seq long")
    changes = spark.createDataFrame([("x", 2, "on"), ("x", 4, "off"), ("y", 0, "on"), ("x", 4, "off")], "k string, since long, mode string")
    known = ordered.in_force(rows, changes, ["k"], "seq", "since", "mode")
    assert sorted(map(tuple, known.collect()), key=str) == sorted([("x", i, None if i < 2 else "on" if i < 4 else "off") for i in range(6)] + [("y", i, "on") for i in range(6)] + [("z", i, None) for i in range(6)], key=str)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # the rows are not sorted
    many = ordered.numbered(spark.range(500).select(F.lit("hot").alias("k"), (F.lit(7) * F.col("id") % 500).alias("v")), "k", [F.col("v")], "n")
    assert sorted((r.v, r.n) for r in many.collect()) == [(i, i + 1) for i in range(500)]
