"""Spans handed on one by one equal those of the batch, whatever the order of arrival."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assemble
from spanloom.sources import events as source
from spanloom.sources import exec_log
from spanloom.streaming import incremental, live
from tests.test_traces import UUID, S, event

T0 = dt.datetime(2024, 1, 1)
BEAT = '{"id": {"progress": {}}}'


def act(label, output, start, ok=True, **more):
    times = {"startTimeNanos": start * S, "endTimeNanos": (start + 1) * S} if start else {}
    return event("actionCompleted", {"label": label, "primaryOutput": output, **more}, action={"success": ok, "type": "Cpp", **times})


def build_of(log, uuid=UUID):
    options = ["--build_event_publish_all_actions"] + (["--execution_log_compact_file=/l"] if log else [])
    return [
        event("fetch", {"url": "early"}, fetch={"success": True}),
        event("started", started={"uuid": uuid, "command": "build", "startTime": "1970-01-01T00:00:10Z"}),
        act("//a:gone", "gone.o", 12),  # not published yet
        event("optionsParsed", optionsParsed={"cmdLine": options}),
        event("pattern", {"pattern": ["//..."]}, expanded={}),
        event("configuration", {"id": "c1"}, configuration={"mnemonic": "k8-opt"}),
        event("targetConfigured", {"label": "//a:lib"}, configured={"targetKind": "cc"}),
        event("targetConfigured", {"label": "@ext//b:x"}, configured={"targetKind": "ext"}),
        event("namedSet", {"id": "1"}, namedSetOfFiles={"files": [{"name": "f1"}, {"name": "f2"}]}),
        act("//a:lib", "a/1.o", 11, configuration={"id": "c1"}), act("//a:lib", "a/2.o", 13), act("@@//a:lib", "a/3.o", 14), act("//z:lone", "z.o", 2, ok=False), act("//a:lib", "a/open.o", None), act("//late:t", "l.o", 15),
        act("//a:lib", "a/unnamed.o", 15, configuration={"id": "unknown"}),
        event("testResult", {"label": "//a:lib", "attempt": 1}, testResult={"status": "PASSED", "testAttemptStart": "1970-01-01T00:00:13Z", "testAttemptDuration": "1.5s"}),
        event("testResult", {"label": "//n:test", "attempt": 1}, testResult={"status": "FAILED", "testAttemptStart": "1970-01-01T00:00:14Z", "testAttemptDuration": "2s"}),
        event("fetch", {"url": "https://x/y"}, fetch={"success": False}),
        event("targetConfigured", {"label": "//late:t"}, configured={"targetKind": "cc"}),
        event("targetCompleted", {"label": "//a:lib"}, completed={"success": True, "outputGroup": [{"name": "d", "fileSets": [{"id": "1"}]}]}),
        event("targetCompleted", {"label": "//skip:me"}, aborted={"reason": "SKIPPED", "description": "why"}),
        event("progress", progress={"stdout": "hi"}),
        event("buildMetrics", buildMetrics={"timingMetrics": {"wallTimeInMs": "20000"}}),
        act("//a:lib", "a/after.o", 28), event("fetch", {"url": "after"}, fetch={"success": True}),
        event("buildFinished", finished={"exitCode": {"code": 0}, "finishTimeMillis": "25000"}),
    ]


def spawn(output_ids, label="//a:lib", start=11, **more):
    return {"spawn": {"targetLabel": label, "mnemonic": "Cpp", "args": ["cc"], "runner": "local", "outputs": [{"outputId": i} for i in output_ids], "metrics": {"startTime": {"seconds": start}, "totalTime": "0.25s"}, **more}}


def log_of():
    file = lambda i, p: {"id": i, "file": {"path": p}}
    return [
        {"invocation": {"hashFunctionName": "SHA-256"}}, file(1, "a/1.o"), file(2, "a/2.o"), spawn([1], cacheHit=True), spawn([1], start=12), spawn([2]), file(9, "A/zz"), file(8, "a/3.o"), spawn([9, 8], "@@//a:lib", 14),  # by its second candidate
        file(2, "a/after.o"), spawn([2], start=27), {"id": 7, "directory": {"path": "d", "files": [{"path": "x"}, {"path": "y"}]}}, spawn([7], "//n:new", 16, exitCode=2), file(6, "l.o"), spawn([6], "//late:t", 15), spawn([], "//n:new", 17),
    ]


def rows_of(spans):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in spans.collect())


def streamed(spark, path, parts, lines, ends, **options):
    """The handed-on rows of each part of the events and lines, then of the heartbeats."""
    event_dir, line_dir, seen = f"{path}/events", f"{path}/lines", []
    spark.createDataFrame([], live.EVENT).write.mode("append").parquet(event_dir)
    spark.createDataFrame([], "inv string, seq long, at timestamp, raw string").write.mode("append").parquet(line_dir)

    def keep(batch, number):
        rows = [r.asDict() for r in batch.collect()]
        seen.append((rows, rows_of(incremental.spans_of(batch)) if rows else []))

    stream = incremental.handed_on(live.read_events(spark, event_dir), incremental.read_lines(spark, line_dir), delay="1 seconds", forget_ms=60_000, **options)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/cp").foreachBatch(keep).start()
    try:
        for part, log in zip(parts, lines, strict=True):
            if log:
                spark.createDataFrame(log, "inv string, seq long, at timestamp, raw string").coalesce(1).write.mode("append").parquet(line_dir)
            if part:
                spark.createDataFrame(part, live.EVENT).coalesce(1).write.mode("append").parquet(event_dir)
            query.processAllAvailable()
        for n, hours in enumerate(ends):
            spark.createDataFrame([("beat", n, T0 + dt.timedelta(hours=hours), BEAT)], live.EVENT).coalesce(1).write.mode("append").parquet(event_dir)
            query.processAllAvailable()
    finally:
        query.stop()
    return [x for x in seen if x[0]]


def batch_rows(spark, events, lines=None):
    good, _ = source.classify(spark.createDataFrame([(f, s, r) for f, s, _, r in events], "file string, seq long, raw string"))
    spawns = exec_log.spawns(exec_log.entries(spark.createDataFrame([(i, s, r) for i, s, _, r in lines], "inv string, seq long, raw string"))) if lines else None
    return rows_of(assemble.build(source.bronze(source.invocations(good)), spawns, assemble.Options(clamp="as_of")))


def feed(name, events):
    last = [e | {"lastMessage": True} if i == len(events) - 1 else e for i, e in enumerate(events)]
    return [(name, i, T0 + dt.timedelta(milliseconds=i), json.dumps(e)) for i, e in enumerate(last)]


def test_without_a_log(spark, tmp_path):
    """Two invocations in a stream; spans go out as their target is known."""
    rows = feed("f", build_of(False) + build_of(False, "second")[1:])
    seen = streamed(spark, str(tmp_path), [rows[:12], rows[12:20], rows[20:]], [[], [], []], [1, 2])
    handed = [r for batch, _ in seen for r in batch]
    early = [json.loads(json.loads(r["doc"])["raw"])["id"] for r in seen[0][0] if r["phase"] == "now"]
    assert [i["fetch"]["url"] for i in early if "fetch" in i] == ["early"] and [i["actionCompleted"]["primaryOutput"] for i in early if "actionCompleted" in i] == ["a/1.o", "a/2.o"]
    assert {r["phase"] for r in handed} == {"now", "close", "early"}
    assert sorted(s for _, spans in seen for s in spans) == batch_rows(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_with_a_log(spark, tmp_path, seed):
    """Events, lines and their repeats in any order, spawns before and after their
    actions: the same spans, and no spawn counts twice."""
    rows = feed("f", build_of(True))
    lines = [("f#1", i, T0 + dt.timedelta(milliseconds=i), json.dumps(e)) for i, e in enumerate(log_of())]
    rng, n = random.Random(seed), 3
    parts = [[] for _ in range(n)]
    logs = [[] for _ in range(n)]
    for r in rows + rows[5:9]:
        parts[rng.randrange(n)].append(r)
    for r in lines + lines[3:6]:
        logs[rng.randrange(n)].append(r)
    seen = streamed(spark, str(tmp_path), parts, logs, [1, 2])
    handed = [r for batch, _ in seen for r in batch]
    assert sorted(s for _, spans in seen for s in spans) == batch_rows(spark, rows, lines)
    assert len({(r["inv"], r["seq"], r["kind"]) for r in handed if r["phase"] in ("now", "close")}) == sum(r["phase"] in ("now", "close") for r in handed)


@pytest.mark.parametrize("log_first", [True, False])
def test_both_orders_of_arrival(spark, tmp_path, log_first):
    """A spawn that comes first waits under its best candidate; one that follows
    goes out at once. Late ones, after the end, are told as late."""
    rows = feed("f", build_of(True))
    lines = [("f#1", i, T0 + dt.timedelta(milliseconds=i), json.dumps(e)) for i, e in enumerate(log_of())]
    late = [("f#1", 99, T0 + dt.timedelta(hours=2), json.dumps(spawn([1])))]
    parts, logs = ([[], rows], [lines, []]) if log_first else ([rows, []], [[], lines])
    seen = streamed(spark, str(tmp_path), [*parts, [("beat", 0, T0 + dt.timedelta(hours=1), BEAT)], [("beat", 1, T0 + dt.timedelta(hours=1, seconds=1), BEAT)], []], [*logs, [], [], late], [])
    now = [json.loads(r["doc"])["action"]["output"] for batch, _ in seen for r in batch if r["phase"] == "now" and r["kind"] == "spawn"]
    assert sorted(now) == ["a/1.o", "a/1.o", "a/2.o", "l.o"]  # the action after the end waits for it
    handed = [r for batch, _ in seen for r in batch]
    assert [(r["seq"], r["kind"]) for r in handed if r["phase"] == "late"] == [(99, "entry")]
    assert sorted(s for _, spans in seen for s in spans) == batch_rows(spark, rows, lines)


def test_gap_and_idle(spark, tmp_path):
    """A lost event holds the following ones until the stream falls idle."""
    rows = [r for r in feed("f", build_of(False))[:-1] if r[1] != 10]
    seen = streamed(spark, str(tmp_path), [rows], [[]], [1, 2], idle_ms=60_000)
    assert sorted(s for _, spans in seen for s in spans) == batch_rows(spark, rows)


def test_log_spawns(spark, tmp_path):
    """Streamed spawns equal those of the whole log: ids written anew, entries
    before their use, shuffled lines; from a fault on nothing comes."""
    lines = [("f#1", i, T0, json.dumps(e)) for i, e in enumerate(log_of())]
    rng = random.Random(4)
    shuffled = rng.sample(lines, len(lines)) + lines[:4]
    bad = [("g#2", i, T0, json.dumps(e)) for i, e in enumerate([{"id": 1, "file": {"path": "p"}}, spawn([1]), spawn([5]), {"id": 5, "file": {"path": "q"}}, spawn([5])])]
    path = f"{tmp_path}/lines"
    schema = "inv string, seq long, at timestamp, raw string"
    spark.createDataFrame(shuffled[:9] + bad[:2], schema).coalesce(1).write.parquet(path)
    query = incremental.log_spawns(incremental.read_lines(spark, path)).writeStream.format("memory").queryName("streamed_spawns").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        spark.createDataFrame(shuffled[9:] + bad[2:], schema).coalesce(1).write.mode("append").parquet(path)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("streamed_spawns")
    want = exec_log.spawns(exec_log.entries(spark.createDataFrame([(i, s, r) for i, s, _, r in lines], "inv string, seq long, raw string")))
    assert rows_of(got.filter("inv = 'f#1'").select(*want.columns)) == rows_of(want)
    assert [r.seq for r in got.filter("inv = 'g#2'").collect()] == [1]
    files = {r.seq: r.listed for r in want.select("seq", F.col("listed")).collect()}
    assert files[5] == ["a/2.o"] and files[10] == ["a/after.o"]  # the same id, before and after it was written anew


def test_keyed_state_meets_the_store_once_a_key():
    """What a call reads and writes is held until it is saved; a new stream is not looked up."""
    class Store:
        def __init__(self):
            self.rows, self.calls = {}, 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "getValue":
                    return self.rows.get(args[0])
                if name == "updateValue":
                    self.rows[args[0]] = args[1]
                if name == "removeKey":
                    self.rows.pop(args[0], None)
                if name == "iterator":
                    return iter(list(self.rows.items()))
                if name == "clear":
                    self.rows.clear()

            return call

    store = Store()
    handle = type("Handle", (), {"getMapState": lambda self, *of: store})()
    state = incremental._Map(handle, "x")
    state.begin(fresh=True)
    for n in range(100):
        state.add("k", n)
        state.put("gone", n)
        state.pop("gone")
    assert store.calls == 0
    state.save()
    assert store.calls == 1 and list(store.rows) == [("k",)]
    assert state.get("k") == list(range(100)) and state.pop("other", 7) == 7 and state.pop("k") and state.items() == []
    state.save()
    assert store.rows == {}
    small = incremental._Map(handle, "x", most=10)
    for n in range(35):
        small.put(n, n)
    assert len(small.held) <= 11 and sorted(v for _, v in small.items()) == list(range(35))


def test_a_small_stream_is_one_entry_of_the_store():
    """What a stream holds stands beside its own entry while it is little; a map that
    has grown goes to the store and is read back from there."""
    import pandas as pd

    calls, kept, timers = [], {}, set()

    class Store:
        def __init__(self, name):
            self.rows = kept.setdefault(name, {})

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "updateValue":
                    self.rows[args[0]] = args[1]
                return {"getValue": lambda: self.rows.get(args[0]), "removeKey": lambda: self.rows.pop(args[0], None), "iterator": lambda: iter(list(self.rows.items())), "clear": self.rows.clear}.get(name, lambda: None)()

            return call

    handle = type("Handle", (), {"getMapState": lambda self, name, *of: Store(name), "registerTimer": lambda self, at: timers.add(at), "deleteTimer": lambda self, at: timers.discard(at)})()
    now = type("Now", (), {"getCurrentWatermarkInMs": lambda self: 10**13})()

    def run(cuts, events):
        kept.clear(), timers.clear(), calls.clear()
        out = []
        for part in [events[i::cuts] for i in reversed(range(cuts))]:
            builder = incremental.TraceBuilder(1000, 1000, 1000, 0, False)
            builder.init(handle)
            before = len(calls)
            frame = pd.DataFrame([(seq, pd.Timestamp(T0), json.dumps(doc)) for seq, doc in part], columns=["seq", "at", "doc"])
            out += [tuple(r) for f in builder.handleInputRows(("f",), iter([frame]), now) for r in f.itertuples(index=False)]
            used = len(calls) - before
        builder = incremental.TraceBuilder(1000, 1000, 1000, 0, False)
        builder.init(handle)
        out += [tuple(r) for f in builder.handleExpiredTimer(("f",), now, None) for r in f.itertuples(index=False)]
        builder.init(handle)
        assert list(builder.handleExpiredTimer(("f",), now, None)) == [] and not any(kept.values())
        return sorted(out), used

    doc = lambda kind, **more: {"what": "event", "raw": kind, "type": kind, "norm": "", "mnemonic": "", "output": "", **more}
    small = [doc("started", uuid="u", start_ns=1), doc("optionsParsed", publishes=True), *[doc("targetConfigured", label=f"//t:{n}") for n in range(8)], *[doc("actionCompleted", label=f"//t:{n}", success=True, start_ns=2, end_ns=3) for n in range(8)], doc("buildFinished", ends=True, last=True)]
    rows, used = run(3, list(enumerate(small)))
    assert rows == run(1, list(enumerate(small)))[0] and len([r for r in rows if r[2] == "now"]) == 8
    assert used <= 2  # its entry is read and written
    large = [*small[:2], *[doc("targetConfigured", label=f"//t:{n}") for n in range(300)], *[doc("actionCompleted", label=f"//t:{n}", success=True, start_ns=2, end_ns=3) for n in range(300)], small[-1]]
    rows, used = run(3, list(enumerate(large)))
    assert rows == run(1, list(enumerate(large)))[0] and len([r for r in rows if r[2] == "now"]) == 300 and used > 300
