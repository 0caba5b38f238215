"""Whole traces from small event logs: targets, actions, spawns, tests, fetches."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assemble, traces, typed
from spanloom.sources import events as source
from spanloom.sources import exec_log

UUID = "aaaaaaaa-bbbb-4ccc-8ddd-eeeeeeeeeeee"
S = 10**9


def event(kind, ident=None, **payload):
    return {"id": {kind: ident or {}}, **payload}


def scenario():
    return [
        event("started", started={"uuid": UUID, "command": "build", "startTime": "1970-01-01T00:00:10Z", "workspaceDirectory": "/ws", "serverPid": "77", "host": "h", "user": ""}),
        event("optionsParsed", optionsParsed={"cmdLine": ["--build_event_publish_all_actions", "--execution_log_compact_file=log.bin", "--define=TOKEN=x"], "explicitCmdLine": ["--execution_log_json_file=j"]}),
        event("workspaceStatus", workspaceStatus={"item": [{"key": "BUILD_USER", "value": "me"}, {"key": "MY_SECRET", "value": "s"}, {"key": "", "value": "n"}]}),
        event("pattern", {"pattern": ["//..."]}, expanded={}),
        event("configuration", {"id": "c1"}, configuration={"mnemonic": "k8-opt", "cpu": "k8"}),
        event("targetConfigured", {"label": "//a:lib"}, configured={"targetKind": "cc_library rule", "tag": ["t1"]}),
        event("targetConfigured", {"label": "@ext//b:x"}, configured={"targetKind": "ext"}),
        event("namedSet", {"id": "1"}, namedSetOfFiles={"files": [{"name": "f1"}, {"uri": "u2"}], "fileSets": [{"id": "2"}]}),
        event("namedSet", {"id": "2"}, namedSetOfFiles={"files": [{"name": "f3"}], "fileSets": [{"id": "1"}, {"id": "missing"}]}),
        event("actionCompleted", {"label": "@@//a:lib", "primaryOutput": "a/lib.o", "configuration": {"id": "c1"}}, action={"success": True, "type": "CppCompile", "startTimeNanos": str(11 * S), "endTimeNanos": 12 * S, "commandLine": ["cc", "--action_env=API_KEY=1"], "stdout": {"uri": "bytestream://h/blobs/1/2"}}),
        event("actionCompleted", {"label": "//z:lone", "primaryOutput": "z.o"}, action={"success": False, "type": "Genrule", "exitCode": 3, "startTimeNanos": 1 * S, "endTimeNanos": 3 * S}),
        event("testResult", {"label": "//a:lib", "attempt": 1, "run": 1, "shard": 2}, testResult={"status": "FLAKY", "testAttemptStart": "1970-01-01T00:00:13Z", "testAttemptDuration": "1.5s"}),
        event("fetch", {"url": "https://x/y"}, fetch={"success": False}),
        event("targetCompleted", {"label": "//a:lib"}, completed={"success": True, "outputGroup": [{"name": "d", "fileSets": [{"id": "1"}]}], "tag": []}),
        event("targetCompleted", {"label": "//skip:me"}, aborted={"reason": "SKIPPED", "description": "why"}),
        event("configuredLabel", {"label": "//bad"}, aborted={"reason": "ANALYSIS_FAILURE", "description": ""}),
        event("progress", progress={"stdout": "\x1b[1mhi\x1b[0m --define=TOKEN=q", "stderr": ""}),
        event("progress", progress={"stdout": "", "stderr": ""}),
        event("buildToolLogs", buildToolLogs={"log": [{"name": "critical path", "uri": "u"}, {"name": "other"}]}),
        event("buildMetrics", buildMetrics={"actionSummary": {"actionsCreated": "5", "actionData": [{"mnemonic": "CppCompile", "actionsExecuted": "4"}], "runnerCount": [{"name": "remote", "count": 2}]}, "timingMetrics": {"wallTimeInMs": "20000"}}),
        event("buildFinished", finished={"exitCode": {"code": 1, "name": "FAIL"}, "finishTimeMillis": "25000"}) | {"lastMessage": True},
        event("progress", progress={"stdout": "after the end"}),
    ]


def log():
    return [
        {"invocation": {"hashFunctionName": "SHA-256"}}, {"id": 1, "file": {"path": "a/lib.o", "digest": {"hash": "h1", "sizeBytes": "9"}}}, {"id": 2, "directory": {"path": "d", "files": [{"path": "x", "digest": {"hash": "h2"}}]}},
        {"spawn": {"targetLabel": "@@//a:lib", "mnemonic": "CppCompile", "args": ["cc", "-c", "s/a.cc"], "runner": "remote", "cacheHit": True, "outputs": [{"outputId": 1}], "metrics": {"startTime": {"seconds": "5"}, "totalTime": "0.5s", "executionWallTime": "0.25s"}}},
        {"spawn": {"targetLabel": "//n:new", "mnemonic": "Link", "outputs": [{"outputId": 2}, {"invalidOutputPath": "bad"}], "exitCode": 2, "status": "NON_ZERO", "metrics": {"startTime": {"seconds": 14}, "totalTime": {"seconds": 1}}}},
    ]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bep")
    (d / "one.ndjson").write_text("\n\n".join(map(json.dumps, scenario())) + "\nnot json\n{\"x\": 1}\n")
    good, bad = source.scan_ndjson(spark, str(d))
    events = source.invocations(good).cache()
    entries = exec_log.entries(spark.createDataFrame([(r[0], i, json.dumps(e)) for r in events.select("inv").distinct().collect() for i, e in enumerate(log())], "inv string, seq long, raw string"))
    return events, bad, entries


def test_scan(built):
    events, bad, _ = built
    kinds = [r.event_type for r in events.orderBy("seq").collect()]
    assert kinds == [next(iter(e["id"])) for e in scenario()[:-1]]
    assert sorted(r.reason for r in bad.collect()) == ["missing event id", "not JSON"]
    assert events.select("inv").distinct().count() == 1


def test_without_log(built):
    events, *_ = built
    spans = {r.name: r for r in assemble.build(events).collect()}
    root = spans["bazel build //..."]
    assert (root.start_ns, root.end_ns, root.status_code, root.status_desc) == (10 * S, 30 * S, "Error", "exit code 1")
    assert root.trace_id == UUID.replace("-", "") and root.parent_span_id is None
    a = root.attrs
    assert a["bazel.workspace.user"] == "me" and a["bazel.workspace.my_secret"] == "***" and a["bazel.metrics.actions.CppCompile"] == "4" and a["bazel.critical_path_log_uri"] == "u" and a["bazel.server_pid"] == "77" and "bazel.workspace." not in a
    lib = spans["target //a:lib"]
    assert (lib.start_ns, lib.end_ns, lib.status_code, lib.parent_span_id) == (11 * S, 30 * S, "Ok", root.span_id)
    assert lib.attrs["bazel.target.tags"] == "t1" and lib.attrs["bazel.target.output_count"] == "3" and set(lib.attrs["bazel.target.output_files"].split(", ")) == {"f1", "u2", "f3"}
    act = spans["action CppCompile //a:lib"]
    assert (act.parent_span_id, act.start_ns, act.end_ns, act.status_code) == (lib.span_id, 11 * S, 12 * S, "Ok")
    assert act.attrs["bazel.action.configuration"] == "k8-opt" and act.attrs["bazel.action.command_line"] == "cc --action_env=API_KEY=***" and act.attrs["bazel.action.stdout"] == "blobs/1/2" and "bazel.action.spawn.count" not in act.attrs
    lone = spans["target //z:lone"]
    assert (lone.start_ns, lone.end_ns, lone.status_code, lone.attrs["bazel.target.synthetic"]) == (10 * S, 12 * S, "Unset", "true")
    assert (spans["action Genrule //z:lone"].start_ns, spans["action Genrule //z:lone"].end_ns, spans["action Genrule //z:lone"].status_desc) == (10 * S, 12 * S, "Action failed")
    t = spans["test //a:lib [attempt=1 run=1 shard=2]"]
    assert (t.start_ns, t.end_ns, t.status_code, t.status_desc, t.parent_span_id) == (13 * S, 14 * S + S // 2, "Error", "FLAKY", lib.span_id)
    assert spans["fetch https://x/y"].parent_span_id == spans["fetches"].span_id and spans["fetch https://x/y"].status_desc == "fetch failed"
    assert spans["target //skip:me"].parent_span_id == spans["skipped targets"].span_id == spans["target //bad"].parent_span_id
    assert spans["target //b:x"].parent_span_id == spans["external deps"].span_id and spans["target //bad"].status_desc == "aborted"
    check = {r.span_id for r in spans.values()}
    assert all(r.parent_span_id in check for r in spans.values() if r.kind != "root")


def test_with_log(built):
    events, _, entries = built
    spawns = exec_log.spawns(entries)
    spans = {r.name: r for r in assemble.build(events, spawns).collect()}
    act = spans["action CppCompile //a:lib"]
    assert act.attrs["bazel.action.spawn.count"] == "1" and act.attrs["bazel.action.spawn.cache_hit"] == "true" and act.attrs["bazel.action.spawn.runner"] == "remote"
    assert spans["action Genrule //z:lone"].attrs["bazel.action.spawn.missing"] == "true"
    spawn = spans["spawn CppCompile s/a.cc"]
    assert (spawn.parent_span_id, spawn.start_ns, spawn.end_ns, spawn.status_code) == (act.span_id, 11 * S, 11 * S + S // 2, "Unset")
    assert spawn.attrs["bazel.spawn.execution_wall_time_ms"] == "250"
    orphan = spans["action Link //n:new (synth)"]
    assert (orphan.start_ns, orphan.end_ns, orphan.status_code) == (14 * S, 15 * S, "Unset")
    link = spans["spawn Link bad"]
    assert link.parent_span_id == orphan.span_id and link.status_desc == "exit_code=2 status=NON_ZERO" and link.attrs["bazel.spawn.listed_outputs"] == "bad, d" and link.attrs["bazel.spawn.output_count"] == "1"
    assert spans["target //n:new"].span_id == orphan.parent_span_id


def test_side_tables(built):
    events, _, entries = built
    (m,) = exec_log.manifest(typed.table(events, "options_parsed"), typed.table(events, "started")).collect()
    assert (m.log, m.path, m.state, m.unsupported) == ("log.bin", "/ws/log.bin", "started", "--execution_log_json_file")
    (line,) = assemble.logs(events).collect()
    assert line.body == "hi --define=TOKEN=***" and line.trace_id == UUID.replace("-", "")
    (s,) = assemble.summary(events).collect()
    assert (s.targets, s.targets_ok, s.targets_failed, s.actions, s.actions_failed, s.exit_code, s["mode"]) == (2, 1, 0, 2, 1, 1, "full")
    names = [r.name for r in assemble.span_events(events).collect()]
    assert sorted(names) == ["build_tool_log", "build_tool_log", "configuration", "configuration_detail"]
    (st,) = exec_log.status(entries).collect()
    assert (st.spawns_received, st.status, st.error) == (2, "ok", None)
    manifest = exec_log.manifest(typed.table(events, "options_parsed"), typed.table(events, "started"))
    told = {r.name: r.attrs for r in assemble.span_events(events, manifest, exec_log.status(entries), with_log=True).collect()}
    assert told["bazel.exec_log.tailer_started"] == {"path": "/ws/log.bin"} and told["bazel.exec_log.tailer_finished"] == {"spawns_received": "2", "status": "ok"}
    assert told["build.log"] == {"bazel.progress.stdout": "hi --define=TOKEN=***"} and told["configuration_detail"]["bazel.config.cpu"] == "k8"
    assert told["bazel.exec_log.unsupported_format"] == {"flag": "--execution_log_json_file"}
    broken = entries.unionByName(exec_log.entries(events.sparkSession.createDataFrame([("broken", 1, '{"spawn": {"outputs": [{"outputId": 5}]}}')], "inv string, seq long, raw string")))
    assert exec_log.spawns(broken, strict=False).select("inv").distinct().count() == 1
    with pytest.raises(Exception, match="output id without entry"):
        exec_log.spawns(broken).collect()
    failed = {r.inv: (r.spawns_received, r.status, r.error) for r in exec_log.status(broken).collect()}
    assert failed["broken"] == (0, "failed", "output id without entry")


def test_caps_envelope_workspace(spark, built):
    rows = spark.createDataFrame([("a", 1, "xx"), ("a", 2, "xxxx"), ("b", 1, "x")], "inv string, seq long, raw string")
    assert [r.inv for r in source.enforce_caps(rows, ["inv"], "raw", ["seq"], entry_bytes=3).collect()] == ["b"]
    assert source.enforce_caps(rows, ["inv"], "raw", ["seq"], total_bytes=6).count() == 3
    with pytest.raises(Exception, match="over its size cap"):
        source.enforce_caps(rows, ["inv"], "raw", ["seq"], total_bytes=5, on_violation="fail").collect()
    env = {"orderedBuildEvent": {"streamId": {"invocationId": "i"}, "sequenceNumber": "4", "event": {"eventTime": "1970-01-01T00:00:01.5Z", "bazelEvent": {"typeUrl": "x/build_event_stream.BuildEvent", "id": {"progress": {}}}}}}
    other = {"orderedBuildEvent": {"event": {"consoleOutput": {}}}}
    (e,) = source.unwrap_envelope(spark.createDataFrame([(json.dumps(env),), (json.dumps(other),)], "value string")).collect()
    assert (e.file, e.seq, e.event_time_ns) == ("i", 4, 1_500_000_000)
    files = [("1", "WORKSPACE", 'workspace(name = "w")', "/x/y"), ("1", "MODULE.bazel", 'module(\n  version = f("1"),\n  name = "m",\n)', "/x/y"), ("2", "WORKSPACE", "# none", "/x/base/")]
    got = {r.inv: r.repository for r in source.workspace_names(spark.createDataFrame(files, "inv string, file_name string, content string, directory string")).collect()}
    assert got == {"1": "m", "2": "base"}


def test_modes_and_restart(spark):
    def act(n, ok):
        return event("actionCompleted", {"label": f"//l:{n}"}, action={"success": ok, "type": "T"})

    flag = {"cmdLine": ["--build_event_publish_all_actions"]}
    off = {"cmdLine": ["--build_event_publish_all_actions", "--nobuild_event_publish_all_actions"]}
    rows = [act(0, True), event("started", started={"uuid": "u"}), act(1, True), event("optionsParsed", optionsParsed=flag), act(2, True), act(3, False), event("optionsParsed", optionsParsed=off), act(4, True), event("started", started={"uuid": "v"}), act(5, True), act(6, False)]
    events, _ = source.classify(spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], "file string, seq long, raw string"))
    kept = assemble.published_actions(source.invocations(events)).select("inv", "label", "mode").collect()
    assert {(r.inv, r.label) for r in kept} == {("f#1", "//l:2"), ("f#1", "//l:3"), ("f#2", "//l:6")}
    assert assemble.build(source.invocations(events)).filter(F.col("kind") == "root").count() == 2


def test_options(built):
    events, _, entries = built
    spawns = exec_log.spawns(entries)
    spans = {r.name: r for r in assemble.build(events, spawns, assemble.Options(cached_from_spawns=True, clamp="as_of", aborted_labels="skipped")).collect()}
    assert (spans["target //bad"].status_code, spans["target //bad"].status_desc) == ("Unset", None)
    assert spans["target @ext//b:x" if "target @ext//b:x" in spans else "target //b:x"].attrs["bazel.target.cached"] == "true"
    assert "bazel.target.cached" not in spans["target //a:lib"].attrs and "bazel.target.cached" not in spans["target //skip:me"].attrs


def test_metrics_groups(built):
    events, *_ = built
    got = {(r.grp, r.name, r.field): r.value for r in typed.metrics_groups(events).collect()}
    assert got == {("action_data", "CppCompile", "actionsExecuted"): 4, ("runner_count", "remote", "count"): 2}


def test_clamp_as_of(spark):
    def act(n):
        return event("actionCompleted", {"label": f"//l:{n}"}, action={"success": False, "type": "T", "startTimeNanos": 5 * S, "endTimeNanos": 50 * S})

    rows = [event("started", started={"uuid": "u", "startTimeMillis": 1000}), act(1), event("buildMetrics", buildMetrics={"timingMetrics": {"wallTimeInMs": 9000}}), act(2)]
    events, _ = source.classify(spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows)], "file string, seq long, raw string"))
    split = source.invocations(events)
    ends = {clamp: {r.name: r.end_ns for r in assemble.build(split, options=assemble.Options(clamp=clamp)).filter("kind = 'action'").collect()} for clamp in ("final", "as_of")}
    assert ends["final"] == {"action T //l:1": 10 * S, "action T //l:2": 10 * S}
    assert ends["as_of"] == {"action T //l:1": 50 * S, "action T //l:2": 10 * S}


def test_depths_work_on_numbers(spark):
    """A chain, a ring, and what hangs below a number that is not there."""
    links = spark.createDataFrame([(n, n - 1 if n else None) for n in range(9)] + [(20, 22), (21, 20), (22, 21), (30, 99)], "n long, up long")
    got = {r.n: r.depth for r in traces.depths(links, lambda: 13).collect()}
    assert got == {n: n for n in range(9)}


def test_a_log_is_parsed_once(spark):
    """Spawns come from the staged log alone, and the text is no longer looked at."""
    rows = [("a", 0, '{"id": 1, "file": {"path": "f"}}'), ("a", 1, '{"spawn": {"outputs": [{"outputId": 1}], "metrics": {"startTime": {"seconds": "2", "nanos": 5}, "totalTime": "1.5s", "queueTime": {"nanos": 7}}}}'), ("a", 2, '{"id": "7", "directory": {"path": "d"}}'), ("a", 3, "no JSON"), ("a", 4, '{"id": 8}'), ("a", 5, '{"file": {"path": "g"}, "id": 9}')]
    log = exec_log.entries(spark.createDataFrame(rows, "inv string, seq long, raw string"))
    assert [(r.seq, r.id, r.kind) for r in log.orderBy("seq").collect()] == [(0, 1, "file"), (1, 0, "spawn"), (2, 7, "directory"), (4, 8, None), (5, 9, "file")]
    spawns = exec_log.spawns(log)
    (s,) = spawns.collect()
    assert (s.start_time_ns, s.totalTime, s.queueTime, s.parseTime, s.end_time_ns, s.listed) == (2_000_000_005, 1_500_000_000, 7, None, 3_500_000_005, ["f"])
    assert "parse_json" not in spawns._jdf.queryExecution().optimizedPlan().toString().lower()


def test_staged_keys_are_not_broadcast_by_the_size_of_their_files(spark):
    keys = traces.stage(spark.range(1_000_000).selectExpr("concat('c', id div 100, '#1', id % 100) AS key", "1 AS n"))
    plan = keys.join(keys.withColumnRenamed("n", "m"), "key")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_parsed_events_tell_invocations_without_their_text(spark):
    """A last message of an ignored kind ends its stream, and nothing is parsed again."""
    rows = [("f", 0, '{"id": {"started": {}}, "started": {"uuid": "u"}}'), ("f", 1, '{"id": {"progress": {}}, "progress": {}}'), ("f", 2, '{"id": {"unknown": {}}, "lastMessage": true}'), ("f", 3, '{"id": {"progress": {}}, "progress": {}}'), ("g", 0, '{"id": {"progress": {}}}')]
    good, _ = source.classify(spark.createDataFrame(rows, "file string, seq long, raw string"))
    told = source.invocations(source.parsed(good))
    assert sorted((r.inv, r.seq) for r in told.collect()) == [("f#1", 0), ("f#1", 1), ("f#1", 2), ("g#1", 0)]
    assert "parse_json" not in told._jdf.queryExecution().optimizedPlan().toString().lower()


def test_spawn_fields_come_from_columns_of_the_staged_log(spark):
    """no entry is built again from the scan; times of every form and of none."""
    import json

    from spanloom.operators.staging import stage
    from spanloom.sources import exec_log

    forms = {"3600s": 3600 * 10**9, "1.5s": 15 * 10**8, "x": None, "5": None, "": None}
    cases = [*forms.items(), ({"seconds": "7", "nanos": 3}, 7 * 10**9 + 3), ({"seconds": 7}, 7 * 10**9), ({"nanos": 9}, 9), ({"seconds": "no", "nanos": 4}, 4), ({"seconds": [1]}, None), ({}, None), ([], None), (5, None), (None, None)]
    rows = [("i", n, json.dumps({"spawn": {"mnemonic": "M", "metrics": {"totalTime": v}}})) for n, (v, _) in enumerate(cases)] + [("i", 99, '{"spawn": {"metrics": 1}}'), ("i", 100, '{"spawn": 2}')]
    log = exec_log.entries(spark.createDataFrame(rows, "inv string, seq long, raw string")).select("inv", "seq", "id", "kind", "v")
    fields = exec_log.spawn_fields(stage(log))
    got = {r.seq: r.totalTime for r in fields.collect()}
    assert got == {n: want for n, (_, want) in enumerate(cases)} | {99: None, 100: None}
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "v:struct<0:string" in plan  # not a whole entry first
