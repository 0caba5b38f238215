"""One query for each kind of event and log entry: rows of the given tables are
written as events of that kind and read back by the typed tables and operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import assemble, ordered, traces, typed
from ..sources import events as source
from ..sources import exec_log, sinks
from ..streaming import live
from .event_queries import _event, build_events
from .queries import ns, query, span_tree, table, _TREE

c, lit = F.col, F.lit


def word(column: str) -> Column:
    return c(column).cast("string")


def stream(rows: DataFrame, file: Column, seq: Column, raw: Column, at: Column | None = None) -> DataFrame:
    """Classified events of invocations from rows that hold their JSON."""
    when = [] if at is None else [at.alias("event_time_ns")]
    good, _ = source.classify(rows.select(file.cast("string").alias("file"), seq.cast("long").alias("seq"), raw.alias("raw"), *when))
    return source.invocations(good)


def of(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


@query("SELECT s_suppkey || '#1' AS inv, 'build ' || s_name || ' --x=' || s_nationkey AS args FROM supplier")
def kind_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.array(lit("build"), c("s_name"), lit(None).cast("string"), F.concat(lit("--x="), word("s_nationkey")))
    raw = _event("unstructuredCommandLine", of(), "unstructuredCommandLine", of(args=args))
    return typed.table(stream(table(spark, sf_dir, "supplier"), c("s_suppkey"), lit(0), raw), "command_line").select("inv", F.array_join("args", " ").alias("args"))


@query("""SELECT s_suppkey || '#1' AS inv, unnest([{'k': 'BUILD_USER', 'v': s_name}, {'k': 'NATION_TOKEN', 'v': s_nationkey::VARCHAR}], recursive := true) FROM supplier""")
def kind_workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda k, v: of(key=lit(k), value=v)
    raw = _event("workspaceStatus", of(), "workspaceStatus", of(item=F.array(item("BUILD_USER", c("s_name")), item("", lit("gone")), item("NATION_TOKEN", word("s_nationkey")))))
    return typed.table(stream(table(spark, sf_dir, "supplier"), c("s_suppkey"), lit(0), raw), "workspace_status").select("inv", c("key").alias("k"), c("value").alias("v"))


@query("SELECT n_regionkey || '#1' AS inv, n_nationkey::VARCHAR AS id, n_name AS mnemonic, 'p' || n_regionkey AS platform, CASE WHEN n_nationkey % 2 = 0 THEN 'k8' END AS cpu, n_nationkey % 3 = 0 AS is_tool FROM nation")
def kind_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = of(mnemonic=c("n_name"), platformName=F.concat(lit("p"), word("n_regionkey")), cpu=F.when(c("n_nationkey") % 2 == 0, "k8"), isTool=c("n_nationkey") % 3 == 0)
    events = stream(table(spark, sf_dir, "nation"), c("n_regionkey"), c("n_nationkey"), _event("configuration", of(id=word("n_nationkey")), "configuration", body))
    return typed.table(events, "configuration").select("inv", "id", "mnemonic", "platform", "cpu", "is_tool")


@query("SELECT p_size || '#1' AS inv, '//' || p_name || ', -//' || p_brand AS patterns FROM part WHERE p_partkey % 2 = 0")
def kind_pattern_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns without what they expanded to are left out."""
    pattern = of(pattern=F.array(F.concat(lit("//"), c("p_name")), F.concat(lit("-//"), c("p_brand"))))
    raw = F.to_json(F.struct(of(pattern=pattern).alias("id"), F.when(c("p_partkey") % 2 == 0, of(done=lit(True))).alias("expanded")))
    return typed.table(stream(table(spark, sf_dir, "part"), c("p_size"), c("p_partkey"), raw), "pattern_expanded").select("inv", F.array_join("patterns", ", ").alias("patterns"))


@query("""SELECT o_custkey || '#1' AS inv, '//o:' || o_orderkey AS label, o_orderstatus = 'P' AS aborted, o_orderstatus <> 'O' OR o_orderstatus = 'P' AS success,
  CASE WHEN o_orderstatus = 'P' THEN 'NO_BUILD' END AS reason, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS description FROM orders""")  # fmt: skip
def kind_target_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed targets, those without a success field and aborted ones."""
    status = c("o_orderstatus")
    body = F.when(status != "P", of(success=F.when(status == "O", False), tag=F.array(status)))
    gone = F.when(status == "P", of(reason=lit("NO_BUILD"), description=c("o_orderpriority")))
    raw = F.to_json(F.struct(of(targetCompleted=of(label=F.concat(lit("//o:"), word("o_orderkey")))).alias("id"), body.alias("completed"), gone.alias("aborted")))
    return typed.table(stream(table(spark, sf_dir, "orders"), c("o_custkey"), c("o_orderkey"), raw), "target_completed").select("inv", "label", "aborted", "success", "reason", "description")


@query("SELECT n_regionkey || '#1' AS inv, n_nationkey::VARCHAR AS set_id, n_name || ',u' || n_nationkey AS files, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1)::VARCHAR ELSE '' END AS children FROM nation")
def kind_named_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(of(name=c("n_name"), uri=lit("not used")), of(name=lit(None).cast("string"), uri=F.concat(lit("u"), word("n_nationkey"))))
    sets = F.when(c("n_nationkey") > 0, F.array(of(id=(c("n_nationkey") - 1).cast("string"))))
    events = stream(table(spark, sf_dir, "nation"), c("n_regionkey"), c("n_nationkey"), _event("namedSet", of(id=word("n_nationkey")), "namedSetOfFiles", of(files=files, fileSets=sets)))
    return typed.table(events, "named_set").select("inv", "set_id", F.array_join("files", ",").alias("files"), F.array_join("children", ",").alias("children"))


@query("SELECT 'p#1' AS inv, url, page_id % 3 = 1 AS success, CASE WHEN page_id % 2 = 0 THEN 'HTTP' END AS downloader FROM pages")
def kind_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = of(url=c("url"), downloader=F.when(c("page_id") % 2 == 0, "HTTP"))
    body = of(success=F.when(c("page_id") % 3 == 0, False).when(c("page_id") % 3 == 1, True))
    return typed.table(stream(table(spark, sf_dir, "pages"), lit("p"), c("page_id"), _event("fetch", ident, "fetch", body)), "fetch").select("inv", "url", "success", "downloader")


@query("""SELECT o_custkey || '#1' AS inv, '//o:' || o_orderkey AS label, (o_orderkey % 3 + 1)::INT AS attempt, o_orderstatus AS status, o_orderkey % 2 = 0 AS cached,
  epoch_us(o_orderdate::TIMESTAMP) * 1000 + o_orderkey % 1000 AS start_ns, (o_orderkey % 100) * 1000000000 + 500000000 AS duration_ns, 'h' || o_custkey AS host FROM orders""")  # fmt: skip
def kind_test_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts as RFC 3339 text with nine digits, durations as text in seconds."""
    start = F.concat(F.date_format(c("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), lit("."), F.lpad((F.unix_micros(c("o_orderdate").cast("timestamp")) % 1_000_000 * 1000 + c("o_orderkey") % 1000).cast("string"), 9, "0"), lit("Z"))
    body = of(status=c("o_orderstatus"), cachedLocally=c("o_orderkey") % 2 == 0, testAttemptStart=start, testAttemptDuration=F.concat((c("o_orderkey") % 100).cast("string"), lit(".5s")), executionInfo=of(hostname=F.concat(lit("h"), word("o_custkey"))))
    ident = of(label=F.concat(lit("//o:"), word("o_orderkey")), attempt=c("o_orderkey") % 3 + 1)
    return typed.table(stream(table(spark, sf_dir, "orders"), c("o_custkey"), c("o_orderkey"), _event("testResult", ident, "testResult", body)), "test_result").select("inv", "label", "attempt", "status", "cached", "start_ns", "duration_ns", "host")


@query("SELECT o_custkey || '#1' AS inv, '//o:' || o_orderkey AS label, o_orderpriority AS status, (o_orderkey % 7)::INT AS total_run_count, (o_orderkey % 5)::INT AS attempt_count, (o_orderkey % 2)::INT AS total_num_cached FROM orders")
def kind_test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = of(overallStatus=c("o_orderpriority"), totalRunCount=c("o_orderkey") % 7, attemptCount=c("o_orderkey") % 5, totalNumCached=c("o_orderkey") % 2)
    events = stream(table(spark, sf_dir, "orders"), c("o_custkey"), c("o_orderkey"), _event("testSummary", of(label=F.concat(lit("//o:"), word("o_orderkey"))), "testSummary", body))
    return typed.table(events, "test_summary").select("inv", "label", "status", "total_run_count", "attempt_count", "total_num_cached")


@query("SELECT o_custkey || '#1' AS inv, '//o:' || o_orderkey AS label, o_orderstatus = 'F' AS build_success, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS test_status FROM orders")
def kind_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = of(overallBuildSuccess=c("o_orderstatus") == "F", overallTestStatus=F.when(c("o_orderkey") % 4 > 0, c("o_orderpriority")))
    events = stream(table(spark, sf_dir, "orders"), c("o_custkey"), c("o_orderkey"), _event("targetSummary", of(label=F.concat(lit("//o:"), word("o_orderkey"))), "targetSummary", body))
    return typed.table(events, "target_summary").select("inv", "label", "build_success", "test_status")


@query("SELECT p_size || '#1' AS inv, '//' || p_name AS patterns FROM part")
def kind_pattern_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.to_json(F.struct(of(patternSkipped=of(pattern=F.array(F.concat(lit("//"), c("p_name"))))).alias("id")))
    return typed.table(stream(table(spark, sf_dir, "part"), c("p_size"), c("p_partkey"), raw), "pattern_skipped").select("inv", F.array_join("patterns", ", ").alias("patterns"))


@query("SELECT s_nationkey || '#1' AS inv, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'configured' ELSE 'unconfigured' END AS id_kind, 'INTERNAL' AS reason, 'n' || s_nationkey AS description FROM supplier")
def kind_aborted_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = c("s_suppkey") % 2 == 1
    ident = F.struct(F.when(odd, of(label=c("s_name"))).alias("unconfiguredLabel"), F.when(~odd, of(label=c("s_name"))).alias("configuredLabel"))
    raw = F.to_json(F.struct(ident.alias("id"), of(reason=lit("INTERNAL"), description=F.concat(lit("n"), word("s_nationkey"))).alias("aborted")))
    return typed.table(stream(table(spark, sf_dir, "supplier"), c("s_nationkey"), c("s_suppkey"), raw), "aborted_label").select("inv", "label", "id_kind", "reason", "description")


def _tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(of(name=c("s_name"), uri=F.concat(lit("bytestream://h/"), word("s_suppkey"))), of(name=F.when(c("s_suppkey") % 2 == 0, "critical path").otherwise("profile"), uri=lit(None).cast("string")))
    return stream(table(spark, sf_dir, "supplier"), c("s_nationkey"), c("s_suppkey"), _event("buildToolLogs", of(), "buildToolLogs", of(log=listed)))


@query("""SELECT s_nationkey || '#1' AS inv, s_name AS name, 'bytestream://h/' || s_suppkey AS uri FROM supplier
UNION ALL SELECT s_nationkey || '#1', CASE WHEN s_suppkey % 2 = 0 THEN 'critical path' ELSE 'profile' END, NULL FROM supplier""")  # fmt: skip
def kind_build_tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.table(_tool_logs(spark, sf_dir), "build_tool_logs").select("inv", "name", "uri")


@query("SELECT s_nationkey || '#1' AS inv, s_suppkey AS seq FROM supplier WHERE s_suppkey % 2 = 0")
def critical_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.critical_logs(_tool_logs(spark, sf_dir)).select("inv", "seq")


@query("SELECT c_custkey || '#1' AS inv, unnest([{'k': 'name', 'v': c_name}, {'k': 'segment', 'v': c_mktsegment}], recursive := true) FROM customer")
def kind_build_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = of(metadata=F.create_map(lit("name"), c("c_name"), lit("segment"), c("c_mktsegment")))
    events = stream(table(spark, sf_dir, "customer"), c("c_custkey"), lit(0), _event("buildMetadata", of(), "buildMetadata", body))
    return typed.table(events, "build_metadata").select("inv", F.explode("metadata").alias("k", "v"))


@query("SELECT 'v' || conv_id || '#1' AS inv, turn AS seq, CASE WHEN role = 'user' THEN text END AS stdout, CASE WHEN role <> 'user' THEN text END AS stderr FROM conversations WHERE coalesce(text, '') <> ''")
def kind_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress without any text is left out."""
    user = c("role") == "user"
    raw = _event("progress", of(opaqueCount=word("turn")), "progress", of(stdout=F.when(user, c("text")), stderr=F.when(~user, c("text"))))
    return typed.table(stream(table(spark, sf_dir, "conversations"), F.concat(lit("v"), word("conv_id")), c("turn"), raw), "progress").select("inv", "seq", "stdout", "stderr")


def metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics document a user: counts of event types, bounds and sums."""
    per_type = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(F.unix_millis(c("ts").cast("timestamp"))).alias("first"))
    data = F.collect_list(of(mnemonic=c("event_type"), actionsExecuted=word("n"), firstStartedMs=word("first")))
    body = of(actionSummary=of(actionData=c("data"), actionsCreated=word("total"), runnerCount=F.array(of(name=lit("total"), count=c("total")))), timingMetrics=of(wallTimeInMs=word("kinds")))
    docs = per_type.groupBy("user_id").agg(data.alias("data"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return stream(docs, c("user_id"), lit(0), _event("buildMetrics", of(), "buildMetrics", body))


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT user_id, sum(n)::BIGINT AS total, count(*) AS kinds FROM t GROUP BY 1)
SELECT user_id || '#1' AS inv, 'actions.' || event_type AS metric, n AS value FROM t UNION ALL SELECT user_id || '#1', 'actions_created', total FROM u
UNION ALL SELECT user_id || '#1', 'runner.total', total FROM u UNION ALL SELECT user_id || '#1', 'wall_time_ms', kinds FROM u""")  # fmt: skip
def metrics_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.flatten_metrics(metrics_events(spark, sf_dir)).select("inv", "metric", "value")


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts) // 1000) AS f FROM events GROUP BY 1, 2)
SELECT user_id || '#1' AS inv, 'action_data' AS grp, event_type AS name, 'actionsExecuted' AS field, n AS value FROM t UNION ALL SELECT user_id || '#1', 'action_data', event_type, 'firstStartedMs', f FROM t
UNION ALL SELECT user_id || '#1', 'runner_count', 'total', 'count', sum(n)::BIGINT FROM t GROUP BY user_id""")  # fmt: skip
def metrics_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.metrics_groups(metrics_events(spark, sf_dir)).drop("seq")


@query("SELECT event_type, event_type = 'unknown' AS ignored, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'unknown' ELSE 'fetch' END AS event_type FROM events) GROUP BY 1")
def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("event_type") == "view", "progress").when(c("event_type") == "click", "unknown").otherwise("fetch")
    raw = F.concat(lit('{"id": {"'), kind, lit('": {}}}'))
    return source.quality(stream(table(spark, sf_dir, "events"), c("user_id"), c("event_id"), raw))


@query("SELECT user_id::VARCHAR AS file, event_id AS seq, epoch_us(ts) * 1000 AS event_time_ns, event_id % 10 AS k FROM events WHERE event_type <> 'view'")
def envelope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in envelopes; views stand for envelopes of another kind."""
    at = F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    name = F.when(c("event_type") == "view", "x/console.Output").otherwise("x/build_event_stream.BuildEvent")
    inner = of(typeUrl=name, id=of(progress=of(opaqueCount=c("event_id") % 10)))
    value = F.to_json(of(orderedBuildEvent=of(streamId=of(invocationId=word("user_id")), sequenceNumber=word("event_id"), event=of(eventTime=at, bazelEvent=inner))))
    got = source.unwrap_envelope(table(spark, sf_dir, "events").select(value.alias("value")))
    return got.select("file", "seq", "event_time_ns", F.get_json_object("raw", "$.id.progress.opaqueCount").cast("long").alias("k"))


@query("SELECT n_nationkey::VARCHAR AS inv, CASE n_nationkey % 3 WHEN 0 THEN 'm' || n_name WHEN 1 THEN 'w' || n_name ELSE 'base' || n_nationkey END AS repository FROM nation")
def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module files before workspace files before the folder's name."""
    nations, n = table(spark, sf_dir, "nation"), c("n_nationkey") % 3
    folder = F.concat(lit("/src/base"), word("n_nationkey"), lit("/"))
    file = lambda kept, name, content: nations.filter(kept).select(word("n_nationkey").alias("inv"), lit(name).alias("file_name"), content.alias("content"), folder.alias("directory"))
    modules = file(n == 0, "MODULE.bazel", F.concat(lit('module(\n  version = "1",\n  name = "m'), c("n_name"), lit('",\n)\nbazel_dep(name = "no")')))
    spaces = file(n < 2, "WORKSPACE", F.concat(lit('workspace(name = "w'), c("n_name"), lit('")')))
    return source.workspace_names(modules.unionByName(spaces).unionByName(file(n == 2, "WORKSPACE", lit("# nothing"))))


_MANIFEST = """WITH m AS (SELECT *, c_custkey % 5 AS k FROM customer)"""


def log_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds whose options name a log: absolute, relative with the workspace known
    before or after, relative without any, and of a format that is not read."""
    k = c("c_custkey") % 5
    flag = F.when(k == 0, "--execution_log_compact_file=/abs/x").when(k == 4, "--execution_log_json_file=j").otherwise("--experimental_execution_log_compact_file=rel/x")
    people = table(spark, sf_dir, "customer")
    options = people.select("c_custkey", lit(5).alias("seq"), _event("optionsParsed", of(), "optionsParsed", of(cmdLine=F.array(lit("--define=a=b"), flag))).alias("raw"))
    begun = people.filter(k != 3).select("c_custkey", F.when(k == 2, 9).otherwise(1).alias("seq"), _event("started", of(), "started", of(uuid=word("c_custkey"), workspaceDirectory=lit("/ws"))).alias("raw"))
    both = options.unionByName(begun)
    return stream(both, c("c_custkey"), c("seq"), c("raw"))


@query(_MANIFEST + """ SELECT c_custkey || '#1' AS inv, CASE k WHEN 0 THEN '/abs/x' WHEN 1 THEN '/ws/rel/x' WHEN 2 THEN '/ws/rel/x' END AS path,
  CASE WHEN k < 3 THEN 'started' WHEN k = 3 THEN 'skipped' ELSE 'unsupported' END AS state, CASE WHEN k = 4 THEN '--execution_log_json_file' ELSE '' END AS unsupported FROM m""")  # fmt: skip
def log_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log_options(spark, sf_dir)
    return exec_log.manifest(typed.table(events, "options_parsed"), typed.table(events, "started")).select("inv", "path", "state", "unsupported")


@query(_MANIFEST + """, e AS (SELECT c_custkey, k, unnest(CASE k WHEN 0 THEN ['started', 'finished'] WHEN 1 THEN ['started', 'finished'] WHEN 2 THEN ['skipped', 'started', 'finished'] WHEN 3 THEN ['skipped'] ELSE ['unsupported'] END) AS step FROM m)
SELECT c_custkey || '#1' AS inv, 'bazel.exec_log.' || CASE step WHEN 'unsupported' THEN 'unsupported_format' ELSE 'tailer_' || step END AS name, CASE step WHEN 'skipped' THEN 'path=rel/x;reason=workspace_directory_not_set'
  WHEN 'started' THEN CASE k WHEN 0 THEN 'path=/abs/x' ELSE 'path=/ws/rel/x' END WHEN 'unsupported' THEN 'flag=--execution_log_json_file'
  ELSE CASE c_custkey % 2 WHEN 0 THEN 'spawns_received=1;status=ok' ELSE 'error=output id without entry;spawns_received=0;status=failed' END END AS attrs FROM e""")  # fmt: skip
def log_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started, skipped, taken up again and finished: events on the roots. The logs
    of odd builds name an output that they lack."""
    events = log_options(spark, sf_dir)
    manifest = exec_log.manifest(typed.table(events, "options_parsed"), typed.table(events, "started"))
    inv, odd = F.concat(word("c_custkey"), lit("#1")).alias("inv"), c("c_custkey") % 2 == 1
    people = table(spark, sf_dir, "customer")
    files = people.filter(~odd).select(inv, lit(0).cast("long").alias("seq"), lit('{"id": 7, "file": {"path": "f"}}').alias("raw"))
    spawns = people.select(inv, lit(1).cast("long").alias("seq"), lit('{"spawn": {"outputs": [{"outputId": 7}]}}').alias("raw"))
    status = exec_log.status(exec_log.entries(files.unionByName(spawns)))
    return assemble.span_events(events, manifest, status).select("inv", "name", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attrs"))


@query("""SELECT s_nationkey::VARCHAR AS inv, count(*) AS spawns_received, 'ok' AS status FROM supplier GROUP BY 1""")
def log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, inv = table(spark, sf_dir, "supplier"), word("s_nationkey").alias("inv")
    files = suppliers.select(inv, lit(0).cast("long").alias("seq"), F.to_json(of(id=c("s_suppkey") + 1, file=of(path=c("s_name")))).alias("raw"))
    spawns = suppliers.select(inv, c("s_suppkey").alias("seq"), F.to_json(of(spawn=of(outputs=F.array(of(outputId=c("s_suppkey") + 1, invalidOutputPath=lit(None).cast("string")), of(outputId=lit(None).cast("long"), invalidOutputPath=lit("x")))))).alias("raw"))
    return exec_log.status(exec_log.entries(files.unionByName(spawns))).select("inv", "spawns_received", "status")


@query("""SELECT s_nationkey::VARCHAR AS inv, s_suppkey AS seq, 'SHA-' || s_nationkey AS hash_function, 'd' || s_suppkey || ',l' || s_suppkey AS listed, 'd' || s_suppkey || '/a,d' || s_suppkey || '/b,l' || s_suppkey AS actual, s_suppkey * 1000000000 + 5 AS start_ns,
  s_suppkey * 1000000000 + 5 + 1500000000 AS end_ns FROM supplier""")  # fmt: skip
def log_spawns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories give their files, symlinks themselves, runfiles nothing."""
    suppliers, inv, key = table(spark, sf_dir, "supplier"), word("s_nationkey").alias("inv"), word("s_suppkey")
    row = lambda df, seq, raw: df.select(inv, seq.cast("long").alias("seq"), F.to_json(raw).alias("raw"))
    heads = row(suppliers.select("s_nationkey").distinct(), lit(-2), of(invocation=of(hashFunctionName=F.concat(lit("SHA-"), word("s_nationkey")))))
    directories = row(suppliers, lit(-1), of(id=c("s_suppkey") * 3 + 1, directory=of(path=F.concat(lit("d"), key), files=F.array(of(path=lit("a")), of(path=lit("b"))))))
    links = row(suppliers, lit(-1), of(id=c("s_suppkey") * 3 + 2, unresolvedSymlink=of(path=F.concat(lit("l"), key), targetPath=lit("t"))))
    trees = row(suppliers, lit(-1), of(id=c("s_suppkey") * 3 + 3, runfilesTree=of(path=lit("r"))))
    outs = F.array(*[of(outputId=c("s_suppkey") * 3 + n) for n in (1, 2, 3)])
    spawns = row(suppliers, c("s_suppkey"), of(spawn=of(outputs=outs, metrics=of(startTime=of(seconds=key, nanos=lit(5)), totalTime=lit("1.5s")))))
    found = exec_log.spawns(exec_log.entries(heads.unionByName(directories).unionByName(links).unionByName(trees).unionByName(spawns)))
    return found.select("inv", "seq", "hash_function", F.array_join("listed", ",").alias("listed"), F.array_join(F.transform("actual", lambda f: f["path"]), ",").alias("actual"), c("start_time_ns").alias("start_ns"), c("end_time_ns").alias("end_ns"))


@query("""WITH d AS (SELECT source, max(octet_length(encode(text))) AS most, sum(octet_length(encode(text))) AS total FROM documents GROUP BY 1)
SELECT doc_id, source FROM documents JOIN d USING (source) WHERE most <= 100000 AND total <= 1000000000""")  # fmt: skip
def size_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are logs; one with an entry or a total over its cap goes whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source.enforce_caps(docs, ["source"], "text", ["doc_id"], entry_bytes=100_000, total_bytes=1_000_000_000).select("doc_id", "source")


_TAIL = 2000
_MARK = "chr(10) || '...(truncated)' || chr(10)"


@query(f"""WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, role, coalesce(text, '')) AS whole FROM conversations GROUP BY 1),
b AS (SELECT *, encode(whole) AS d, octet_length(encode(whole)) AS n FROM t),
k AS (SELECT *, CASE WHEN n > {_TAIL} THEN (SELECT min(k) FROM range(n - {_TAIL} + 16, n - {_TAIL} + 20) r(k) WHERE NOT (hex(d[k + 1:k + 1]) BETWEEN '80' AND 'BF')) END AS cut FROM b)
SELECT conv_id, CASE WHEN cut IS NULL THEN whole ELSE {_MARK} || decode(d[cut + 1:n]) END AS tail FROM k""")  # fmt: skip
def progress_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bytes of a conversation, the chunk that crosses the limit cut."""
    return ordered.tail(table(spark, sf_dir, "conversations"), ["conv_id"], "text", ["turn", "role"], _TAIL).select("conv_id", "tail")


@query("SELECT o_custkey || '#1' AS inv, count(*) AS n, CASE WHEN count(*) > 2 THEN 'full' ELSE 'short' END AS size FROM orders GROUP BY 1")
def invocation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a stream's last message do not count."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", c("o_orderkey").alias("seq"), lit('{"id": {"fetch": {}}}').alias("raw"))
    ends = orders.groupBy("o_custkey").agg(F.max("seq").alias("seq")).select("o_custkey", "seq", lit('{"id": {"buildFinished": {}}, "lastMessage": true}').alias("raw"))
    late = ends.select("o_custkey", (c("seq") + 1).alias("seq"), lit('{"id": {"progress": {}}}').alias("raw"))
    kept = stream(orders.unionByName(ends).unionByName(late), c("o_custkey"), c("seq"), c("raw")).filter("event_type <> 'buildFinished'")
    n = F.count("*")
    return kept.groupBy("inv").agg(n.alias("n")).withColumn("size", F.when(c("n") > 2, "full").otherwise("short"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN epoch_us(l_shipdate::TIMESTAMP) * 1000 >= 1000000000000000000 THEN epoch_us(l_shipdate::TIMESTAMP) * 1000 END AS at_ns FROM lineitem")
def absolute_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", times.absolute(ns("l_shipdate")).alias("at_ns"))


@query("SELECT event_id, epoch_us(ts) AS shown_us, 0::BIGINT AS before_epoch_us FROM events")
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanoseconds are cut, not rounded, and instants before the epoch become it."""
    at = ns("ts") + 999
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(times.to_timestamp(at)).alias("shown_us"), F.unix_micros(times.to_timestamp(-at)).alias("before_epoch_us"))


@query("SELECT 'c' || o_custkey || '#1' AS inv, '//order:' || l_orderkey AS label, count(*) AS actions, count(*) FILTER (l_returnflag = 'R') AS actions_failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def actions_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = source.classify(build_events(spark, sf_dir))
    return assemble.action_counts(source.invocations(source.parsed(good)))


@query(_TREE + """, x AS (SELECT *, CASE kind WHEN 'root' THEN 0 WHEN 'target' THEN 1 ELSE 2 END AS depth FROM t),
p AS (SELECT x.*, a.start_ns AS a_start, a.span_id AS a_id, b.start_ns AS b_start, b.span_id AS b_id FROM x LEFT JOIN x a ON a.trace_id = x.trace_id AND a.span_id = x.parent_span_id LEFT JOIN x b ON b.trace_id = a.trace_id AND b.span_id = a.parent_span_id),
q AS (SELECT *, CASE depth WHEN 0 THEN start_ns WHEN 1 THEN a_start ELSE b_start END AS s0, CASE depth WHEN 1 THEN start_ns WHEN 2 THEN a_start END AS s1, CASE depth WHEN 1 THEN span_id WHEN 2 THEN a_id END AS i1, CASE depth WHEN 2 THEN start_ns END AS s2, CASE depth WHEN 2 THEN span_id END AS i2 FROM p)
SELECT trace_id, depth::INT AS depth, kind, start_ns, (row_number() OVER (PARTITION BY trace_id ORDER BY s0, s1 NULLS FIRST, i1 NULLS FIRST, s2 NULLS FIRST, i2 NULLS FIRST))::INT AS place FROM q""")  # fmt: skip
def trace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span's depth and its place in the order of the tree."""
    spans = span_tree(spark, sf_dir).select("trace_id", "span_id", "parent_span_id", "kind", "start_ns", "end_ns")
    return traces.tree_order(spans, "trace_id", "span_id", "parent_span_id", "start_ns", "end_ns").select("trace_id", "depth", "kind", "start_ns", "place")


@query(_TREE + """, b AS (SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id) - 1) // 10 AS batch FROM t) SELECT trace_id, batch, count(*) AS spans FROM b GROUP BY 1, 2""")
def otlp_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most ten spans each, counted from the JSON."""
    spans = span_tree(spark, sf_dir).withColumnsRenamed({"status": "status_code"}).withColumns({"status_desc": lit(None).cast("string"), "attrs": F.create_map(lit("k"), lit("v"))})
    found = F.json_array_length(F.get_json_object("value", "$.resourceSpans[0].scopeSpans[0].spans"))
    return sinks.otlp_json(spans, batch=10).select("trace_id", "batch", found.cast("long").alias("spans"))


@query("SELECT 'v' || conv_id AS file, turn AS seq, CASE WHEN role = 'user' THEN text ELSE '' END AS stdout, CASE WHEN role = 'user' THEN '' ELSE text END AS stderr FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE coalesce(text, '') <> '')")
def live_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as a stream that ends: read from files, repeated events known by
    their number, one record an event."""
    user = c("role") == "user"
    raw = _event("progress", of(opaqueCount=word("turn")), "progress", of(stdout=F.when(user, c("text")), stderr=F.when(~user, c("text"))))
    rows = table(spark, sf_dir, "conversations").select(F.concat(lit("v"), word("conv_id")).alias("file"), c("turn").alias("seq"), F.timestamp_seconds(lit(10**9)).alias("at"), raw.alias("raw"))
    src = traces.stage(rows.unionByName(rows))
    (folder,) = {f.rsplit("/", 1)[0] for f in src.inputFiles()}
    kept = live.progress(live.deduplicated(live.read_events(spark, folder)))
    out = f"{folder}-out"
    kept.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out).drop("at")
