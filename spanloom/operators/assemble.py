"""From typed events and spawns to the tables of a trace.

spans: inv, trace_id, span_id, parent_span_id, kind, name, start_ns, end_ns,
status_code, status_desc, attrs (map of strings without nulls or empties). Parents
are joined by invocation; nothing is collected and no order beyond seq is used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, labels, redact, status, text
from ..functions.times import clamp
from ..sources import exec_log
from . import ordered, traces, typed
from .staging import passing

#: Fixed value: what attribute keys and root spans begin with.
TOOL = "bazel"
#: Options that turn publishing of all actions on or off.
PUBLISH = "--build_event_publish_all_actions"
_ON, _OFF = (PUBLISH, f"{PUBLISH}=true", f"{PUBLISH}=1"), (PUBLISH.replace("--", "--no", 1), f"{PUBLISH}=false", f"{PUBLISH}=0")
#: Fixed value: how many files an attribute names.
SHOWN = 20
_SPAN = ("inv", "trace_id", "span_id", "parent_span_id", "kind", "name", "start_ns", "end_ns", "status_code", "status_desc", "attrs")


@dataclass(frozen=True)
class Options:
    """redactor: what to hide. missing_target_success: what a completed target
    without the field is. cached_from_spawns: a target is cached unless a spawn of
    it missed the cache (else every target counts as cached, tests apart).
    clamp: `final` fits all spans into the invocation's final end, `as_of` only
    those that came after the end was known. aborted_labels: `error_span` or
    `skipped`, how labels that were aborted by themselves come out."""

    redactor: redact.Redactor = redact.Redactor()
    missing_target_success: bool = True
    cached_from_spawns: bool = False
    clamp: str = "final"
    aborted_labels: str = "error_span"


def attributes(**values: Column) -> Column:
    """A map of the given values as strings, nulls and empty texts left out. Dots
    in keys are written as two underscores."""
    one = lambda k, v: F.array(F.struct(F.lit(f"{TOOL}.{k.replace('__', '.')}").alias("key"), v.alias("value")))
    none = F.array().cast("array<struct<key string, value string>>")
    each = [F.when(F.nullif(v.cast("string"), F.lit("")).isNotNull(), one(k, v.cast("string"))).otherwise(none) for k, v in values.items()]
    return F.map_from_entries(F.concat(*each))  # without a lambda, which would not be compiled


def publishes_all(opts: Column) -> Column:
    return F.exists(opts, lambda o: o.isin(*_ON)) & ~F.exists(opts, lambda o: o.isin(*_OFF))


def modes(events: DataFrame) -> DataFrame:
    """inv, mode, from_seq: full or lightweight from each options event on."""
    opts = typed.table(events, "options_parsed")
    return opts.select("inv", F.col("seq").alias("from_seq"), F.when(publishes_all(F.concat("cmd_line", "explicit")), "full").otherwise("lightweight").alias("mode"))


def published_actions(events: DataFrame) -> DataFrame:
    """Actions that the mode in force at their place lets through: failed ones
    always, others in full mode. Options events are few: they become intervals that
    the actions of their invocation fall into, and no action is sorted."""
    known = ordered.in_force(typed.table(events, "action_completed"), modes(events), ["inv"], "seq", "from_seq", "mode")
    return known.withColumn("mode", F.coalesce("mode", F.lit("lightweight"))).filter("not success or mode = 'full'")


def roots(events: DataFrame) -> DataFrame:
    """One row an invocation: ids, bounds, exit code, command and patterns."""
    started = ordered.first(typed.table(events, "started"), ["inv"], [F.col("seq")])
    finished = ordered.latest(typed.table(events, "build_finished"), ["inv"], [F.col("seq")]).select("inv", "exit_code", "exit_name", "finish_ns")
    wall = typed.flatten_metrics(events).filter("metric = 'wall_time_ms'").groupBy("inv").agg(F.max_by("value", "seq").alias("wall_ms"), F.min("seq").alias("wall_seq"))
    ends = typed.table(events, "build_finished").groupBy("inv").agg(F.min("seq").alias("finish_seq"))
    patterns = typed.table(events, "pattern_expanded").groupBy("inv").agg(F.max_by("patterns", "seq").alias("patterns"))
    joined = started.drop("event_time_ns", "seq").join(finished, "inv", "left").join(wall, "inv", "left").join(patterns, "inv", "left").join(ends, "inv", "left").withColumn("end_seq", F.least("wall_seq", "finish_seq"))
    trace = ids.trace_id(F.coalesce("uuid", "inv"))
    end = F.coalesce(F.col("start_ns") + F.col("wall_ms") * 1_000_000, "finish_ns")
    return joined.withColumns({"trace_id": trace, "root_id": ids.span_id(trace, "root"), "end_ns": end}).withColumnRenamed("start_ns", "root_start").withColumnRenamed("end_ns", "root_end")


def root_attributes(events: DataFrame, options: Options = Options()) -> DataFrame:
    """inv, attrs: every attribute written to a root, later ones winning."""
    r = options.redactor

    def rows(kind: str, *pairs: tuple[str, Column]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f"{TOOL}.{k}").alias("key"), v.cast("string").alias("value")) for k, v in pairs])
        return typed.table(events, kind).select("inv", "seq", F.explode(each).alias("a")).select("inv", "seq", "a.key", "a.value")

    c = F.col
    joined = lambda column, sep=" ": F.array_join(r.args(c(column)), sep)
    parts = [
        rows("started", ("invocation_id", c("uuid")), ("command", c("command")), ("workspace_directory", c("workspace_dir")), ("working_directory", c("working_dir")), ("build_tool_version", c("tool_version")), ("server_pid", c("server_pid")), ("workspace.host", c("host")), ("workspace.user", c("user"))),
        rows("command_line", ("command_line", text.truncate_bytes(joined("args"), text.ATTRIBUTE_BYTES, "...(truncated)"))),
        rows("options_parsed", ("startup_options", joined("startup")), ("explicit_cmd_line", joined("explicit")), ("tool_tag", c("tool_tag"))),
        rows("pattern_expanded", ("patterns", F.array_join("patterns", ", "))),
        rows("build_finished", ("exit_code", c("exit_code")), ("exit_code_name", c("exit_name"))),
    ]
    items = typed.table(events, "workspace_status")
    name = F.when(c("key") == "BUILD_USER", "user").when(c("key") == "BUILD_HOST", "host").otherwise(F.lower("key"))
    parts.append(items.select("inv", "seq", F.concat(F.lit(f"{TOOL}.workspace."), name).alias("key"), r.named(c("key"), c("value")).alias("value")))
    meta = typed.table(events, "build_metadata").select("inv", "seq", F.explode("metadata").alias("key", "value"))
    parts.append(meta.select("inv", "seq", F.concat(F.lit(f"{TOOL}.metadata."), "key").alias("key"), r.named(c("key"), c("value")).alias("value")))
    parts.append(typed.flatten_metrics(events).select("inv", "seq", F.concat(F.lit(f"{TOOL}.metrics."), "metric").alias("key"), c("value").cast("string").alias("value")))
    parts.append(typed.critical_logs(events).select("inv", "seq", F.lit(f"{TOOL}.critical_path_log_uri").alias("key"), c("uri").alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return ordered.merge_attributes(whole.filter("value is not null and value <> ''"), ["inv"])


def output_counts(events: DataFrame, completed: DataFrame) -> DataFrame:
    """inv, label, output_count and outputs (the first of them): the files that each
    completed target's sets reach, by the depth of the set, its id and their place.
    Sets that several targets name are followed once."""
    sets = ordered.latest(typed.table(events, "named_set").drop("event_time_ns"), ["inv", "set_id"], [F.col("seq")])
    key = lambda s: F.concat_ws("\x01", "inv", s)
    edges = sets.select(key(F.col("set_id")).alias("a"), F.explode("children").alias("c"), "inv").select("a", key(F.col("c")).alias("b"))
    wanted = completed.select("inv", "label", F.explode("file_set_ids").alias("s"))
    reached = traces.closure(edges, wanted.select(key(F.col("s")).alias("r")), "a", "b", "r")
    files = sets.select(key(F.col("set_id")).alias("node"), F.posexplode("files").alias("pos", "file"))
    nearest = wanted.withColumn("root", key(F.col("s"))).join(reached, "root").groupBy("inv", "label", "node").agg(F.min("depth").alias("depth"))
    listed = traces.first_and_total(nearest.join(files, "node"), ["inv", "label"], "file", ["depth", "node", "pos", "file"], SHOWN)
    return listed.select("inv", "label", F.col("total").alias("output_count"), F.col("shown").alias("outputs"))


def action_counts(events: DataFrame) -> DataFrame:
    """inv, label, actions: published actions of each target."""
    return published_actions(events).groupBy("inv", "label").agg(F.count("*").alias("actions"), F.count_if(~F.col("success")).alias("actions_failed"))


def _final(df: DataFrame, kind: str, parent: Column, span: Column, name: Column, start: Column, end: Column, state: Column, attrs: Column) -> DataFrame:
    return df.select("inv", "trace_id", span.alias("span_id"), parent.alias("parent_span_id"), F.lit(kind).alias("kind"), name.alias("name"), start.alias("start_ns"), end.alias("end_ns"), state["code"].alias("status_code"), state["description"].alias("status_desc"), attrs.alias("attrs"))


def _under_root(df: DataFrame, shorts: DataFrame, options: Options) -> DataFrame:
    """df with its invocation's trace and bounds; upper is the end that binds it."""
    upper = F.col("root_end") if options.clamp == "final" else F.when(F.col("end_seq") < F.col("seq"), F.col("root_end"))
    return df.join(shorts, "inv").withColumn("upper", upper)


def _label_id(label: Column) -> Column:
    return ids.span_id(F.col("trace_id"), "target", label)


def _group_id(group: str | Column) -> Column:
    return ids.span_id(F.col("trace_id"), "group", F.lit(group) if isinstance(group, str) else group)


def _action_bounds() -> tuple[Column, Column]:
    c = F.col
    return clamp(c("start_ns"), F.coalesce("end_ns", "completed_ns", "root_end"), c("root_start"), c("upper"))


def _action_id() -> Column:
    c = F.col
    return ids.span_id(c("trace_id"), "action", c("label"), c("mnemonic"), c("output"), c("seq"))


def without_log(actions: DataFrame) -> DataFrame:
    """Actions of an invocation without an execution log."""
    return actions.withColumns({"orphan": F.lit(False), "has_log": F.lit(False), "spawn_count": F.lit(None).cast("long"), "s": F.lit(None).cast("struct<runner string, cache_hit boolean, remote_cacheable boolean, digest string>")})


def action_spans(acts: DataFrame, options: Options = Options()) -> DataFrame:
    """Spans of actions that know their owner (a target's label), the owner's end
    (completed_ns), config_name and what their spawns tell."""
    c, (s, e) = F.col, _action_bounds()
    first_of = lambda n: F.when(c("s").isNotNull(), c(f"s.{n}"))
    attrs = attributes(action__label=c("label"), action__label_short=labels.shorten_label(c("label")), action__mnemonic=c("mnemonic"), action__success=c("success"), action__exit_code=c("exit_code"), action__exit_code_name=c("exit_name"), action__primary_output=c("output"), action__configuration=c("config_name"), action__command_line=text.truncate_bytes(F.array_join(options.redactor.args(c("args")), " "), text.ATTRIBUTE_BYTES, "...(truncated)"), action__stdout=text.bytestream_display(c("stdout")), action__stderr=text.bytestream_display(c("stderr")), action__spawn__count=F.when(c("has_log"), F.coalesce("spawn_count", F.lit(0).cast("long"))), action__spawn__missing=F.when(c("has_log") & c("spawn_count").isNull(), True), action__spawn__runner=first_of("runner"), action__spawn__cache_hit=first_of("cache_hit"), action__spawn__remote_cacheable=first_of("remote_cacheable"), action__spawn__digest=first_of("digest"))
    state = status.success_status(F.when(~c("orphan"), c("success")), "Action failed")
    return _final(acts, "action", F.when(c("label").isNotNull(), _label_id(c("owner"))).otherwise(c("root_id")), _action_id(), labels.action_name(c("mnemonic"), c("label"), c("orphan")), s, e, state, attrs)


def test_spans(tests: DataFrame) -> DataFrame:
    """Spans of tests that know their owner."""
    c = F.col
    s, e = clamp(c("start_ns"), c("start_ns") + c("duration_ns"), c("root_start"), c("upper"))
    attrs = attributes(test__status=c("status"), test__attempt=c("attempt"), test__run=c("run"), test__shard=c("shard"), test__cached_locally=c("cached"), test__cached_remotely=c("cached_remotely"), test__strategy=c("strategy"), test__hostname=c("host"), target__label=c("label"))
    return _final(tests, "test", _label_id(c("owner")), ids.span_id(c("trace_id"), "test", c("label"), c("attempt"), c("run"), c("shard"), c("seq")), labels.test_name(c("label"), c("attempt"), c("run"), c("shard")), s, e, status.test_status(c("status")), attrs)


def fetch_spans(fetched: DataFrame) -> DataFrame:
    c, arrival = F.col, F.coalesce("event_time_ns", "root_start")
    attrs = attributes(fetch__url=c("url"), fetch__success=c("success"), fetch__downloader=c("downloader"))
    return _final(fetched, "fetch", _group_id("fetches"), ids.span_id(c("trace_id"), "fetch", c("url"), c("seq")), labels.fetch_name(c("url")), arrival, arrival + 1_000_000, status.success_status(c("success"), "fetch failed"), attrs)


def target_spans(targets: DataFrame) -> DataFrame:
    c = F.col
    skipped = F.coalesce("aborted", F.lit(False))
    start = F.when(c("synthetic"), c("child_start")).when(skipped, c("completed_ns")).otherwise(F.coalesce("configured_ns", "child_start", "root_start"))
    end = F.when(c("synthetic"), c("child_end")).otherwise(F.coalesce("completed_ns", "root_end"))
    s, e = clamp(start, end, c("root_start"), c("upper"))
    parent = F.when(skipped, _group_id("skipped targets")).when(labels.is_external(c("label")), _group_id("external deps")).otherwise(c("root_id"))
    state = F.when(c("synthetic") | skipped, F.lit(None).cast("boolean")).otherwise(c("success"))
    tags = F.when(F.size("tags") > 0, c("tags")).otherwise(c("configured_tags"))
    attrs = attributes(target__label=c("label"), target__label_short=labels.shorten_label(c("label")), target__kind=c("kind"), target__test_size=c("test_size"), target__tags=F.array_join(tags, ", "), target__success=F.when(~skipped, c("success")), target__cached=F.when(c("tested").isNull() & ~skipped & ~c("synthetic"), c("cached")), target__abort_reason=c("reason"), target__abort_description=c("description"), target__synthetic=F.when(c("synthetic"), True), target__output_count=c("output_count"), target__output_files=text.first_and_count(c("outputs"), SHOWN, total=c("output_count")))
    return _final(targets, "target", parent, _label_id(c("label")), labels.target_name(c("label")), s, e, status.success_status(state, "target failed"), attrs)


def aborted_spans(stopped: DataFrame, options: Options = Options()) -> DataFrame:
    c = F.col
    state = status.aborted_status(c("description")) if options.aborted_labels == "error_span" else status.success_status(F.lit(None).cast("boolean"), "")
    return _final(stopped, "target", _group_id("skipped targets"), ids.span_id(c("trace_id"), "aborted", c("label"), c("seq")), labels.target_name(c("label")), F.lit(None).cast("long"), c("event_time_ns"), state, attributes(target__label=c("label"), target__abort_reason=c("reason"), target__abort_description=c("description")))


def spawn_spans(owned: DataFrame, options: Options = Options()) -> DataFrame:
    """Spans of spawns that know their action's span and bounds (a_start, a_end)."""
    c = F.col
    timed = F.when(c("totalTime").isNotNull(), c("start_time_ns"))
    s, e = clamp(timed, timed + c("totalTime"), c("a_start"), c("a_end"))
    return _final(owned, "spawn", c("action_span"), ids.span_id(c("trace_id"), "spawn", c("seq")), labels.spawn_name(c("mnemonic"), c("args"), c("listed"), F.transform("actual", lambda f: f["path"])), s, e, status.spawn_status(c("exit_code"), c("status")), spawn_attributes(options))


def spawn_keys(spawns: DataFrame) -> DataFrame:
    """spawns with what they may know their action by."""
    candidates = labels.spawn_candidates(F.col("listed"), F.transform("actual", lambda f: f["path"]))
    return spawns.withColumns({"norm": labels.normalize_label(F.coalesce("label", F.lit(""))), "mnemonic": F.coalesce("mnemonic", F.lit("")), "candidates": candidates, "first_candidate": F.get(candidates, 0)})


#: What an action takes from its first spawn.
TOLD = ("runner", "cache_hit", "remote_cacheable", "digest")


@dataclass(frozen=True)
class Early:
    """What a live run has already handed on, told in few rows.

    children: inv, kind (action, test or fetch), label, start_ns, end_ns, seq, at
    least the first and the last child of each label. spawns: inv, action_seq,
    spawn_count, seq (of the first), s (what it tells) and norm and missed (whether
    one missed the cache), a row an action."""

    children: DataFrame
    spawns: DataFrame | None = None


def build(events: DataFrame, spawns: DataFrame | None = None, options: Options = Options(), early: Early | None = None) -> DataFrame:
    """All spans of all invocations. spawns: as exec_log.spawns gives them. early:
    spans that are out already count as children, but are not built again.

    What several branches use is staged once: roots, published actions, targets,
    the owner of each label, spawns with the action that they match (without what
    can be told from their other columns), and the spans that group spans are told
    by. Spawns and actions as they are before they have met go when they have. Actions, tests and spawns are not: a caller that
    reads their spans more than once stages them, and one that reads a few columns
    has only those built."""
    c, root = F.col, traces.stage(roots(events))
    shorts = root.select("inv", "trace_id", "root_id", "root_start", "root_end", "end_seq")

    configured = ordered.latest(typed.table(events, "target_configured"), ["inv", "label"], [c("seq")]).withColumnRenamed("event_time_ns", "configured_ns").withColumnRenamed("seq", "configured_seq").withColumnRenamed("tags", "configured_tags")
    done_rows = typed.table(events, "target_completed", options.missing_target_success)
    done = ordered.latest(done_rows, ["inv", "label"], [c("seq")]).withColumnRenamed("event_time_ns", "completed_ns").withColumnRenamed("seq", "closed_seq")
    seen = traces.stage(traces.lifecycle(configured, done, ["inv", "label"]))
    actions = published_actions(events).drop("event_time_ns")
    tests = typed.table(events, "test_result")
    placed = None
    if spawns is not None:
        with passing(events.sparkSession) as keep:
            actions, spawns = traces.stage(actions), traces.stage(spawns)
            keyed = ordered.latest(actions.select("inv", labels.normalize_label(F.coalesce("label", F.lit(""))).alias("norm"), F.coalesce("mnemonic", F.lit("")).alias("mnemonic"), F.coalesce("output", F.lit("")).alias("output"), "seq"), ["inv", "norm", "mnemonic", "output"], [c("seq")]).withColumnRenamed("seq", "action_seq")
            matched = traces.match_ranked(spawn_keys(spawns), keyed, ["inv"], ["seq"], "candidates", ["norm", "mnemonic"], "output", "action_seq").drop("rank")
            placed = spawn_keys(keep(spawns.join(matched, ["inv", "seq"], "left"))).drop("candidates")
            lone = placed.filter("action_seq is null")
            orphan = lone.groupBy("inv", "norm", "mnemonic", "first_candidate").agg(F.min("start_time_ns").alias("start_ns"), F.max("end_time_ns").alias("end_ns"), F.count("*").alias("spawn_count"), F.min_by("label", "seq").alias("label"))
            told = placed.filter("action_seq is not null").select("inv", "action_seq", F.lit(1).cast("long").alias("spawn_count"), "seq", F.struct(*TOLD).alias("s"))
            logged = placed.select("inv")
            if early is not None and early.spawns is not None:
                told, logged = told.unionByName(early.spawns.select(*told.columns)), logged.unionByName(early.spawns.select("inv"))
            first = told.groupBy("inv", c("action_seq").alias("seq")).agg(F.sum("spawn_count").alias("spawn_count"), F.min_by("s", told["seq"]).alias("s"))
            actions = actions.join(first, ["inv", "seq"], "left").join(logged.distinct().withColumn("has_log", F.lit(True)), "inv", "left").withColumns({"orphan": F.lit(False), "has_log": F.coalesce("has_log", F.lit(False))})
            lost = orphan.select("inv", "label", "mnemonic", c("first_candidate").alias("output"), "start_ns", "end_ns", "spawn_count", F.lit(True).alias("success"), F.lit(True).alias("orphan"), F.lit(True).alias("has_log"), F.lit(-1).cast("long").alias("seq"))
            actions = keep(actions.unionByName(lost, allowMissingColumns=True))
    else:
        actions = without_log(traces.stage(actions))

    # whose child is a label: a target of that label, or of its normal form, or one known by its children alone
    children = actions.select("inv", "label", "start_ns", "end_ns", "seq").unionByName(tests.select("inv", "label", "start_ns", (c("start_ns") + c("duration_ns")).alias("end_ns"), "seq")).filter("label is not null")
    tested = tests.select("inv", "label")
    if early is not None:
        children = children.unionByName(early.children.filter("kind <> 'fetch' and label is not null").select(*children.columns))
        tested = tested.unionByName(early.children.filter("kind = 'test'").select("inv", "label"))
    found = traces.parents(children.select("inv", "label").distinct(), seen.select("inv", c("label").alias("target"), c("label").alias("t")), ["inv"], "label", "target", "t")
    owners = traces.stage(found.select("inv", "label", F.coalesce("parent", "label").alias("owner")).join(seen.select("inv", c("label").alias("owner"), "completed_ns"), ["inv", "owner"], "left"))
    ranges = traces.child_bounds(children.join(owners, ["inv", "label"]).select("inv", c("owner").alias("label"), "start_ns", "end_ns", "seq"), ["inv", "label"], "start_ns", "end_ns", c("seq")).drop("children")
    targets = seen.join(ranges, ["inv", "label"], "full").withColumn("synthetic", c("state").isNull())
    targets = targets.join(output_counts(events, done), ["inv", "label"], "left")
    targets = targets.join(tested.distinct().withColumn("tested", F.lit(True)), ["inv", "label"], "left").withColumn("cached", F.lit(True))
    if options.cached_from_spawns and placed is not None:
        missed = placed.filter("not cache_hit").select("inv", "norm")
        missed = missed if early is None or early.spawns is None else missed.unionByName(early.spawns.filter("missed").select("inv", "norm"))
        targets = targets.withColumn("norm", labels.normalize_label(c("label"))).join(missed.distinct().withColumn("missed", F.lit(True)), ["inv", "norm"], "left").withColumn("cached", c("missed").isNull())
    under_groups = target_spans(_under_root(targets.withColumn("seq", c("closed_seq")), shorts, options))
    under_groups = under_groups.unionByName(fetch_spans(_under_root(typed.table(events, "fetch"), shorts, options)))
    under_groups = under_groups.unionByName(aborted_spans(_under_root(typed.table(events, "aborted_label"), shorts, options), options))

    configs = ordered.latest(typed.table(events, "configuration").select("inv", "id", "mnemonic", "seq"), ["inv", "id"], [c("seq")]).select("inv", c("id").alias("configuration"), c("mnemonic").alias("config_mnemonic"))
    acts = _under_root(traces.named(actions.join(owners, ["inv", "label"], "left"), configs, ["inv"], "configuration", "config_mnemonic", "config_name"), shorts, options)
    whole = action_spans(acts, options)
    whole = whole.unionByName(test_spans(_under_root(tests.join(owners, ["inv", "label"]), shorts, options)))
    if placed is not None:
        known = traces.stage(action_rows(acts))
        to_action = placed.filter("action_seq is not null").join(known.filter("not orphan").select("inv", c("seq").alias("action_seq"), "action_span", "a_start", "a_end"), ["inv", "action_seq"])
        to_orphan = placed.filter("action_seq is null").join(known.filter("orphan").drop("seq", "orphan"), ["inv", "norm", "mnemonic", "first_candidate"])
        whole = whole.unionByName(spawn_spans(_under_root(to_action.unionByName(to_orphan.select(*to_action.columns)), shorts, options), options))

    told = traces.stage(under_groups)  # the group spans are told by their children
    groups = told.filter("kind = 'fetch'").select("inv", F.lit("fetches").alias("g"), "start_ns")
    if early is not None:
        groups = groups.unionByName(early.children.filter("kind = 'fetch'").select("inv", F.lit("fetches").alias("g"), "start_ns"))
    open_targets = told.filter("kind = 'target' and start_ns is not null")
    groups = groups.unionByName(open_targets.join(shorts.select("inv", "root_id"), "inv").filter("parent_span_id <> root_id").select("inv", F.when(c("status_code").isNotNull() & c("attrs").getItem(f"{TOOL}.target.abort_reason").isNotNull(), "skipped targets").otherwise("external deps").alias("g"), "start_ns"))
    groups = groups.unionByName(told.filter("kind = 'target' and start_ns is null").select("inv", F.lit("skipped targets").alias("g"), c("end_ns").alias("start_ns")))
    grouped = traces.groups(groups, ["inv"], "g", "start_ns").join(shorts, "inv")
    group_spans = _final(grouped, "group", c("root_id"), _group_id(c("g")), c("g"), F.coalesce("first", "root_start"), c("root_end"), status.success_status(F.when(c("g") != "skipped targets", True), ""), F.create_map().cast("map<string,string>"))

    attrs = root_attributes(events, options)
    root_rows = root.select("inv", "trace_id", "root_id", "root_start", "root_end", "command", "patterns", "exit_code").join(attrs, "inv", "left")
    root_spans = _final(root_rows, "root", F.lit(None).cast("string"), c("root_id"), labels.root_name(c("command"), c("patterns"), TOOL), c("root_start"), c("root_end"), status.root_status(c("exit_code")), F.coalesce("attrs", F.create_map().cast("map<string,string>")))
    return root_spans.unionByName(group_spans).unionByName(told).unionByName(whole).select(*_SPAN)


def action_rows(acts: DataFrame) -> DataFrame:
    """What spawns need of their action: id, bounds, and what an orphan, and only
    that, is known by."""
    c, (s, e) = F.col, _action_bounds()
    of_orphan = lambda v: F.when(c("orphan"), v)
    return acts.select("inv", "seq", "orphan", of_orphan(labels.normalize_label(F.coalesce("label", F.lit("")))).alias("norm"), of_orphan(c("mnemonic")).alias("mnemonic"), of_orphan(c("output")).alias("first_candidate"), _action_id().alias("action_span"), s.alias("a_start"), e.alias("a_end"))


def spawn_attributes(options: Options) -> Column:
    c = F.col
    ms = {f"spawn__{n}_ms": F.nullif((c(d) / 1_000_000).cast("long"), F.lit(0).cast("long")) for n, d in (("execution_wall_time", "executionWallTime"), ("queue_time", "queueTime"), ("network_time", "networkTime"), ("setup_time", "setupTime"), ("fetch_time", "fetchTime"), ("upload_time", "uploadTime"), ("process_outputs_time", "processOutputsTime"), ("retry_time", "retryTime"), ("parse_time", "parseTime"))}
    shown = F.concat(F.array_join(F.slice("listed", 1, SHOWN), ", "), F.when(F.size("listed") > SHOWN, F.concat(F.lit("... ("), F.size("listed").cast("string"), F.lit(" outputs total)"))).otherwise(""))
    return attributes(spawn__target_label=c("label"), spawn__target_label_short=labels.shorten_label(c("label")), spawn__mnemonic=c("mnemonic"), spawn__runner=c("runner"), spawn__cache_hit=c("cache_hit"), spawn__remote_cacheable=c("remote_cacheable"), spawn__status=c("status"), spawn__exit_code=F.nullif("exit_code", F.lit(0)), spawn__digest=c("digest"), spawn__primary_output=F.get("listed", 0), spawn__listed_outputs=shown, spawn__output_count=F.nullif(F.size("actual"), F.lit(0)), spawn__command=text.truncate_bytes(F.array_join(options.redactor.args(c("args")), " "), text.ATTRIBUTE_BYTES, "...(truncated)"), **ms)


def build_log(events: DataFrame, redactor: redact.Redactor = redact.Redactor(), limit: int = text.PROGRESS_BYTES) -> DataFrame:
    """inv, seq, stdout and stderr: the tail of each stream of progress, for those
    who keep no log records. seq is that of the last event."""
    progress = typed.table(events, "progress").select("inv", "seq", F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), redactor.text(text.strip_ansi(F.col(n))).alias("body")) for n in ("stdout", "stderr")])).alias("p"))
    rows = progress.select("inv", "seq", "p.stream", "p.body").filter("body <> ''")
    tails = ordered.tail(rows, ["inv", "stream"], "body", ["seq"], limit)
    last = rows.groupBy("inv").agg(F.max("seq").alias("seq"))
    sides = tails.groupBy("inv").agg(*[F.max(F.when(F.col("stream") == n, F.col("tail"))).alias(n) for n in ("stdout", "stderr")])
    return last.join(sides, "inv")


def span_events(events: DataFrame, manifest: DataFrame | None = None, log_status: DataFrame | None = None, with_log: bool = False, redactor: redact.Redactor = redact.Redactor()) -> DataFrame:
    """inv, seq, name, attrs: the ordered events on the roots. manifest and
    log_status: as exec_log.manifest and exec_log.status give them; with_log: one
    event holds the tails of the progress streams."""
    c = F.col

    def rows(df: DataFrame, name: str, attrs: Column) -> DataFrame:
        return df.select("inv", "seq", F.lit(name).alias("name"), attrs.alias("attrs"))

    get = lambda kind: typed.table(events, kind)
    out = rows(get("configuration"), "configuration", attributes(config__id=c("id"), config__mnemonic=c("mnemonic"), config__platform=c("platform")))
    out = out.unionByName(rows(get("configuration").filter("nullif(cpu, '') is not null or is_tool is not null"), "configuration_detail", attributes(config__id=c("id"), config__cpu=c("cpu"), config__is_tool=c("is_tool"))))
    out = out.unionByName(rows(get("test_summary"), "test_summary", attributes(target__label=c("label"), test__overall_status=c("status"), test__total_run_count=c("total_run_count"), test__run_count=c("run_count"), test__attempt_count=c("attempt_count"), test__shard_count=c("shard_count"), test__total_num_cached=c("total_num_cached"))))
    out = out.unionByName(rows(get("target_summary"), "target_summary", attributes(target__label=c("label"), target__overall_build_success=c("build_success"), target__overall_test_status=c("test_status"))))
    out = out.unionByName(rows(get("pattern_skipped"), "pattern_skipped", attributes(patterns=F.array_join("patterns", ", "))))
    out = out.unionByName(rows(get("build_tool_logs"), "build_tool_log", attributes(log__name=c("name"), log__uri=c("uri"))))
    if manifest is not None:
        for seq, name, told in exec_log.steps(log_status is not None):
            side = manifest if log_status is None else manifest.join(log_status, "inv", "left")
            out = out.unionByName(side.withColumn("seq", seq).filter("seq is not null").select("inv", "seq", F.lit(f"{TOOL}.exec_log.{name}").alias("name"), told.alias("attrs")))
    if with_log:
        out = out.unionByName(rows(build_log(events, redactor), "build.log", attributes(progress__stderr=c("stderr"), progress__stdout=c("stdout"))))
    return out


def logs(events: DataFrame, redactor: redact.Redactor = redact.Redactor()) -> DataFrame:
    """One record per progress event: trace and root ids, cleaned and capped body."""
    clean = lambda column: text.tail_bytes(redactor.text(text.strip_ansi(F.coalesce(column, F.lit("")))), text.PROGRESS_BYTES)
    ids_of = roots(events).select("inv", "trace_id", F.col("root_id").alias("span_id"))
    body = typed.table(events, "progress").select("inv", "seq", "event_time_ns", clean("stdout").alias("stdout"), clean("stderr").alias("stderr"))
    return body.join(ids_of, "inv").select("inv", "trace_id", "span_id", "seq", "event_time_ns", F.lit("INFO").alias("severity"), F.concat_ws("\n", F.nullif("stdout", F.lit("")), F.nullif("stderr", F.lit(""))).alias("body"), "stdout", "stderr")


def summary(events: DataFrame) -> DataFrame:
    """One row an invocation: targets and published actions, exit code, mode."""
    done = typed.table(events, "target_completed").filter("not aborted")
    configured = typed.table(events, "target_configured").select("inv", "label").distinct()
    known = ordered.latest(done.select("inv", "label", "success", "seq"), ["inv", "label"], [F.col("seq")])
    targets = configured.join(known, ["inv", "label"], "left").groupBy("inv").agg(F.count("*").alias("targets"), F.count_if("success").alias("targets_ok"), F.count_if(~F.col("success")).alias("targets_failed"))
    acts = published_actions(events).groupBy("inv").agg(F.count("*").alias("actions"), F.count_if(~F.col("success")).alias("actions_failed"))
    mode = modes(events).groupBy("inv").agg(F.max_by("mode", "from_seq").alias("mode"))
    whole = roots(events).select("inv", "trace_id", "command", "exit_code", "root_start", "root_end").join(targets, "inv", "left").join(acts, "inv", "left").join(mode, "inv", "left")
    counts = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("targets", "targets_ok", "targets_failed", "actions", "actions_failed")}
    line = F.format_string("Build Summary: %d targets (%d ok, %d failed), %d actions (%d failed), exit code %s, mode %s", *counts.values(), F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown")), F.coalesce("mode", F.lit("lightweight")))
    return whole.withColumns(counts | {"mode": F.coalesce("mode", F.lit("lightweight")), "end_before_start": F.col("root_end") < F.col("root_start"), "summary": line})
