"""One typed table per event kind, by a declarative list of paths.

Values are taken with try_variant_get: a missing path or a wrong type is null,
and 64-bit integers come quoted or bare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import rfc3339_nanos

_FILES, _IDS, _TEXTS = "array<struct<name string, uri string>>", "array<struct<id string>>", "array<string>"
#: kind -> (event ids, column -> (path, type)). Paths start at the event.
KINDS: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, str]]]] = {
    "started": (("started",), {"uuid": ("$.started.uuid", "string"), "command": ("$.started.command", "string"), "start_ms": ("$.started.startTimeMillis", "bigint"), "start_text": ("$.started.startTime", "string"), "workspace_dir": ("$.started.workspaceDirectory", "string"), "working_dir": ("$.started.workingDirectory", "string"), "tool_version": ("$.started.buildToolVersion", "string"), "server_pid": ("$.started.serverPid", "bigint"), "host": ("$.started.host", "string"), "user": ("$.started.user", "string")}),
    "command_line": (("unstructuredCommandLine",), {"args": ("$.unstructuredCommandLine.args", _TEXTS)}),
    "options_parsed": (("optionsParsed",), {"startup": ("$.optionsParsed.startupOptions", _TEXTS), "explicit": ("$.optionsParsed.explicitCmdLine", _TEXTS), "cmd_line": ("$.optionsParsed.cmdLine", _TEXTS), "tool_tag": ("$.optionsParsed.toolTag", "string")}),
    "workspace_status": (("workspaceStatus",), {"items": ("$.workspaceStatus.item", "array<struct<key string, value string>>")}),
    "configuration": (("configuration",), {"id": ("$.id.configuration.id", "string"), "mnemonic": ("$.configuration.mnemonic", "string"), "platform": ("$.configuration.platformName", "string"), "cpu": ("$.configuration.cpu", "string"), "is_tool": ("$.configuration.isTool", "boolean")}),
    "build_finished": (("buildFinished",), {"exit_code": ("$.finished.exitCode.code", "int"), "exit_name": ("$.finished.exitCode.name", "string"), "finish_ms": ("$.finished.finishTimeMillis", "bigint"), "finish_text": ("$.finished.finishTime", "string")}),
    "pattern_expanded": (("pattern",), {"patterns": ("$.id.pattern.pattern", _TEXTS), "expanded": ("$.expanded", "variant")}),
    "target_configured": (("targetConfigured",), {"label": ("$.id.targetConfigured.label", "string"), "kind": ("$.configured.targetKind", "string"), "test_size": ("$.configured.testSize", "string"), "tags": ("$.configured.tag", _TEXTS)}),
    "target_completed": (("targetCompleted",), {"label": ("$.id.targetCompleted.label", "string"), "success": ("$.completed.success", "boolean"), "groups": ("$.completed.outputGroup", "array<struct<fileSets " + _IDS + ">>"), "tags": ("$.completed.tag", _TEXTS), "reason": ("$.aborted.reason", "string"), "description": ("$.aborted.description", "string"), "aborted": ("$.aborted", "variant")}),
    "named_set": (("namedSet",), {"set_id": ("$.id.namedSet.id", "string"), "files": ("$.namedSetOfFiles.files", _FILES), "children": ("$.namedSetOfFiles.fileSets", _IDS)}),
    "action_completed": (("actionCompleted",), {"label": ("$.id.actionCompleted.label", "string"), "output": ("$.id.actionCompleted.primaryOutput", "string"), "configuration": ("$.id.actionCompleted.configuration.id", "string"), "success": ("$.action.success", "boolean"), "mnemonic": ("$.action.type", "string"), "exit_code": ("$.action.exitCode", "int"), "exit_name": ("$.action.failureDetail.message", "string"), "args": ("$.action.commandLine", _TEXTS), "stdout": ("$.action.stdout", "string"), "stdout_uri": ("$.action.stdout.uri", "string"), "stderr": ("$.action.stderr", "string"), "stderr_uri": ("$.action.stderr.uri", "string"), "start_ns": ("$.action.startTimeNanos", "bigint"), "start_text": ("$.action.startTime", "string"), "end_ns": ("$.action.endTimeNanos", "bigint"), "end_text": ("$.action.endTime", "string")}),
    "fetch": (("fetch",), {"url": ("$.id.fetch.url", "string"), "downloader": ("$.id.fetch.downloader", "string"), "success": ("$.fetch.success", "boolean")}),
    "test_result": (("testResult",), {"label": ("$.id.testResult.label", "string"), "attempt": ("$.id.testResult.attempt", "int"), "run": ("$.id.testResult.run", "int"), "shard": ("$.id.testResult.shard", "int"), "status": ("$.testResult.status", "string"), "cached": ("$.testResult.cachedLocally", "boolean"), "strategy": ("$.testResult.executionInfo.strategy", "string"), "host": ("$.testResult.executionInfo.hostname", "string"), "cached_remotely": ("$.testResult.executionInfo.cachedRemotely", "boolean"), "start_ns": ("$.testResult.testAttemptStartNanos", "bigint"), "start_text": ("$.testResult.testAttemptStart", "string"), "duration_ns": ("$.testResult.testAttemptDurationNanos", "bigint"), "duration_text": ("$.testResult.testAttemptDuration", "string")}),
    "test_summary": (("testSummary",), {"label": ("$.id.testSummary.label", "string"), "status": ("$.testSummary.overallStatus", "string"), "total_run_count": ("$.testSummary.totalRunCount", "int"), "run_count": ("$.testSummary.runCount", "int"), "attempt_count": ("$.testSummary.attemptCount", "int"), "shard_count": ("$.testSummary.shardCount", "int"), "total_num_cached": ("$.testSummary.totalNumCached", "int")}),
    "target_summary": (("targetSummary",), {"label": ("$.id.targetSummary.label", "string"), "build_success": ("$.targetSummary.overallBuildSuccess", "boolean"), "test_status": ("$.targetSummary.overallTestStatus", "string")}),
    "progress": (("progress",), {"stdout": ("$.progress.stdout", "string"), "stderr": ("$.progress.stderr", "string")}),
    "pattern_skipped": (("patternSkipped",), {"patterns": ("$.id.patternSkipped.pattern", _TEXTS)}),
    "aborted_label": (("unconfiguredLabel", "configuredLabel"), {"plain": ("$.id.unconfiguredLabel.label", "string"), "configured": ("$.id.configuredLabel.label", "string"), "reason": ("$.aborted.reason", "string"), "description": ("$.aborted.description", "string")}),
    "build_tool_logs": (("buildToolLogs",), {"logs": ("$.buildToolLogs.log", _FILES)}),
    "build_metadata": (("buildMetadata",), {"metadata": ("$.buildMetadata.metadata", "map<string,string>")}),
    "build_metrics": (("buildMetrics",), {"metrics": ("$.buildMetrics", "variant")}),
}

_BASE = ("inv", "seq", "event_time_ns")


def raw_table(events: DataFrame, kind: str) -> DataFrame:
    """inv, seq, event_time_ns and the listed columns, as they are in the events.
    The filter on event_type comes before any parsing of paths."""
    ids, columns = KINDS[kind]
    got = events.filter(F.col("event_type").isin(*ids))
    return got.select(*_BASE, *[F.try_variant_get("v", path, of).alias(name) for name, (path, of) in columns.items()])


def times(kind: str, at: Callable[[str], Column]) -> dict[str, Column]:
    """Start, end and duration of a kind in nanoseconds, from its listed columns."""
    if kind == "started":
        return {"start_ns": F.coalesce(at("event_time_ns"), rfc3339_nanos(at("start_text")), at("start_ms") * 1_000_000)}
    if kind == "action_completed":
        return {n: F.coalesce(at(n), rfc3339_nanos(at(f"{n[:-3]}_text"))) for n in ("start_ns", "end_ns")}
    if kind == "test_result":
        seconds = F.regexp_extract(at("duration_text"), r"^([0-9]+(?:\.[0-9]+)?)s$", 1).try_cast("decimal(20,9)")
        return {"start_ns": F.coalesce(at("start_ns"), rfc3339_nanos(at("start_text"))), "duration_ns": F.coalesce(at("duration_ns"), (seconds * 1_000_000_000).cast("long"))}
    return {}


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def table(events: DataFrame, kind: str, missing_target_success: bool = True) -> DataFrame:
    """The typed table of a kind, with defaults, times in nanoseconds and lists
    without nulls."""
    raw = raw_table(events, kind)
    lists = [n for n, (_, of) in KINDS[kind][1].items() if of == _TEXTS]
    raw = raw.withColumns({n: F.coalesce(F.filter(n, lambda x: x.isNotNull()), F.array().cast(_TEXTS)) for n in lists}) if lists else raw
    if kind == "started":
        return raw.withColumns({"command": F.coalesce(_blank("command"), F.lit("unknown")), **times(kind, F.col), "host": _blank("host"), "user": _blank("user")}).drop("start_ms", "start_text")
    if kind == "build_finished":
        return raw.withColumn("finish_ns", F.coalesce(rfc3339_nanos(F.col("finish_text")), F.col("finish_ms") * 1_000_000)).drop("finish_ms", "finish_text")
    if kind == "workspace_status":
        return raw.select(*_BASE, F.explode("items").alias("i")).select(*_BASE, "i.key", "i.value").filter("key <> ''")
    if kind == "pattern_expanded":
        return raw.filter("expanded is not null").drop("expanded")
    if kind == "target_completed":
        sets = F.flatten(F.transform("groups", lambda g: F.coalesce(F.transform(g["fileSets"], lambda s: s["id"]), F.array().cast(_TEXTS))))
        return raw.withColumns({"aborted": F.col("aborted").isNotNull(), "success": F.coalesce("success", F.lit(missing_target_success)), "file_set_ids": F.coalesce(sets, F.array().cast(_TEXTS))}).drop("groups").filter("label is not null")
    if kind == "named_set":
        files = F.transform("files", lambda f: F.coalesce(F.nullif(f["name"], F.lit("")), f["uri"]))
        return raw.withColumns({"files": F.coalesce(F.filter(files, lambda f: f.isNotNull()), F.array().cast(_TEXTS)), "children": F.coalesce(F.transform("children", lambda c: c["id"]), F.array().cast(_TEXTS))})
    if kind == "action_completed":
        plain = lambda c: F.coalesce(F.col(f"{c}_uri"), F.when(~F.startswith(c, F.lit("{")), F.col(c)))
        return raw.withColumns(times(kind, F.col) | {"success": F.coalesce("success", F.lit(False)), "exit_name": _blank("exit_name"), "stdout": plain("stdout"), "stderr": plain("stderr")}).drop("start_text", "end_text", "stdout_uri", "stderr_uri")
    if kind == "fetch":
        return raw.withColumn("success", F.coalesce("success", F.lit(False)))
    if kind == "test_result":
        return raw.withColumns(times(kind, F.col) | {"host": _blank("host")}).drop("start_text", "duration_text").filter("label is not null")
    if kind == "progress":
        return raw.filter("coalesce(stdout, '') <> '' or coalesce(stderr, '') <> ''")
    if kind == "aborted_label":
        return raw.withColumns({"label": F.coalesce("configured", "plain"), "id_kind": F.when(F.col("configured").isNotNull(), "configured").otherwise("unconfigured")}).drop("plain", "configured").filter("label is not null")
    if kind == "build_tool_logs":
        return raw.select(*_BASE, F.explode("logs").alias("l")).select(*_BASE, "l.name", "l.uri")
    return raw


def critical_logs(events: DataFrame) -> DataFrame:
    return table(events, "build_tool_logs").filter(F.contains("name", F.lit("critical")))


#: Scalar metrics: name -> path in the metrics document.
METRICS = {
    "actions_created": "$.actionSummary.actionsCreated", "actions_executed": "$.actionSummary.actionsExecuted", "cache_hits": "$.actionSummary.actionCacheStatistics.hits", "cache_misses": "$.actionSummary.actionCacheStatistics.misses",
    "wall_time_ms": "$.timingMetrics.wallTimeInMs", "cpu_time_ms": "$.timingMetrics.cpuTimeInMs", "analysis_phase_ms": "$.timingMetrics.analysisPhaseTimeInMs", "execution_phase_ms": "$.timingMetrics.executionPhaseTimeInMs", "actions_execution_start_ms": "$.timingMetrics.actionsExecutionStartInMs",
    "heap_post_build": "$.memoryMetrics.usedHeapSizePostBuild", "peak_heap_post_gc": "$.memoryMetrics.peakPostGcHeapSize", "targets_configured": "$.targetMetrics.targetsConfigured", "packages_loaded": "$.packageMetrics.packagesLoaded",
    "source_artifacts_count": "$.artifactMetrics.sourceArtifactsRead.count", "output_artifacts_count": "$.artifactMetrics.outputArtifactsSeen.count", "action_cache_artifacts_count": "$.artifactMetrics.outputArtifactsFromActionCache.count", "top_level_artifacts_count": "$.artifactMetrics.topLevelArtifacts.count",
    "bytes_sent": "$.networkMetrics.systemNetworkStats.bytesSent", "bytes_recv": "$.networkMetrics.systemNetworkStats.bytesRecv", "cumulative_num_analyses": "$.cumulativeMetrics.numAnalyses", "cumulative_num_builds": "$.cumulativeMetrics.numBuilds",
}


def flatten_metrics(events: DataFrame) -> DataFrame:
    """inv, metric, value: scalar metrics, actions by mnemonic, runners by name."""
    doc = raw_table(events, "build_metrics")
    get = lambda p, of: F.try_variant_get("metrics", p, of)
    one = [F.struct(F.lit(n).alias("metric"), get(p, "bigint").alias("value")) for n, p in METRICS.items()]
    actions = F.transform(get("$.actionSummary.actionData", "array<struct<mnemonic string, actionsExecuted bigint>>"), lambda a: F.struct(F.concat(F.lit("actions."), a["mnemonic"]).alias("metric"), a["actionsExecuted"].alias("value")))
    runners = F.transform(get("$.actionSummary.runnerCount", "array<struct<name string, count bigint>>"), lambda r: F.struct(F.concat(F.lit("runner."), r["name"]).alias("metric"), r["count"].alias("value")))
    none = F.array().cast("array<struct<metric string, value bigint>>")
    every = F.concat(F.array(*one), F.coalesce(actions, none), F.coalesce(runners, none))
    return doc.select("inv", "seq", F.explode(every).alias("m")).select("inv", "seq", "m.metric", "m.value").filter("value is not null")


#: Lists in the metrics document: group -> (path, name field, value fields).
GROUPS = {
    "action_data": ("$.actionSummary.actionData", "mnemonic", ("actionsExecuted", "actionsCreated", "firstStartedMs", "lastEndedMs")),
    "runner_count": ("$.actionSummary.runnerCount", "name", ("count",)),
    "cache_misses": ("$.actionSummary.actionCacheStatistics.missDetails", "reason", ("count",)),
    "garbage": ("$.memoryMetrics.garbageMetrics", "type", ("garbageCollected",)),
    "package_load": ("$.packageMetrics.packageLoadMetrics", "name", ("numTargets", "computationSteps", "numTransitiveLoads")),
    "workers": ("$.workerMetrics", "mnemonic", ("actionsExecuted", "priorActionsExecuted")),
    "worker_pools": ("$.workerPoolMetrics.workerPoolStats", "mnemonic", ("createdCount", "destroyedCount", "evictedCount", "aliveCount")),
    "races": ("$.dynamicExecutionMetrics.raceStatistics", "mnemonic", ("localWins", "remoteWins")),
    "graph_values": ("$.buildGraphMetrics.evaluatedValues", "skyfunctionName", ("count",)),
}


def metrics_groups(events: DataFrame) -> DataFrame:
    """inv, seq, grp, name, field, value: every list of the metrics, one row a number."""
    doc = raw_table(events, "build_metrics")
    none = F.array().cast("array<struct<grp string, name string, field string, value bigint>>")
    parts = []
    for group, (path, name, fields) in GROUPS.items():
        kind = f"array<struct<`{name}` string, " + ", ".join(f"`{f}` bigint" for f in fields) + ">>"
        each = F.transform(F.try_variant_get("metrics", path, kind), _numbers(group, name, fields))
        parts.append(F.coalesce(F.flatten(each), none))
    rows = doc.select("inv", "seq", F.explode(F.concat(*parts)).alias("m"))
    return rows.select("inv", "seq", "m.*").filter("value is not null")


def _numbers(group: str, name: str, fields: tuple[str, ...]):
    def one(item: Column) -> Column:
        return F.array(*[F.struct(F.lit(group).alias("grp"), item[name].alias("name"), F.lit(f).alias("field"), item[f].alias("value")) for f in fields])

    return one
