"""The event pipeline over events that Spark derives from the given tables:
customers are invocations, orders targets, lines actions and spawns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, typed
from ..operators.staging import passing
from ..sources import events as source
from ..sources import exec_log
from .queries import _DAY, ns, query, table


def _event(kind: str, ident: Column, payload: str | None = None, body: Column | None = None, last: bool = False) -> Column:
    parts = [F.struct(ident.alias(kind)).alias("id")] + ([body.alias(payload)] if payload else []) + ([F.lit(True).alias("lastMessage")] if last else [])
    return F.to_json(F.struct(*parts))


def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, event_time_ns, raw of every customer's build."""
    c, none = F.col, F.lit(None).cast("long")
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"), ns("o_orderdate").alias("at"), "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("ord"), "l_linenumber", "l_partkey", "l_suppkey", ns("l_shipdate").alias("ship"), "l_returnflag")
    lines = lines.join(orders.select("ord", "cust"), "ord")
    span = orders.groupBy("cust").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    text = lambda x: x.cast("string")
    label = F.concat(F.lit("//order:"), text(c("ord")))
    empty = F.struct(F.lit(None).cast("string").alias("_"))
    row = lambda df, seq, at, raw: df.select(F.concat(F.lit("c"), text(c("cust"))).alias("file"), F.lit(seq).cast("long").alias("seq"), at.alias("event_time_ns"), raw.alias("raw"))
    parts = [
        row(span, 0, c("lo"), _event("started", empty, "started", F.struct(F.concat(F.lit("build-"), text(c("cust"))).alias("uuid"), F.lit("build").alias("command")))),
        row(span, 1, none, _event("optionsParsed", empty, "optionsParsed", F.struct(F.array(F.lit(assemble.PUBLISH)).alias("cmdLine")))),
        row(orders, 10, c("at"), _event("targetConfigured", F.struct(label.alias("label")), "configured", F.struct(c("o_orderpriority").alias("targetKind")))),
        row(lines, 20, none, _event("actionCompleted", F.struct(label.alias("label"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("primaryOutput")), "action", F.struct((c("l_returnflag") != "R").alias("success"), F.lit("Ship").alias("type"), text(c("ship")).alias("startTimeNanos"), text(c("ship") + _DAY).alias("endTimeNanos")))),
        row(orders.filter("o_orderstatus <> 'O'"), 30, c("at") + 60 * _DAY, _event("targetCompleted", F.struct(label.alias("label")), "completed", F.struct((c("o_orderstatus") == "F").alias("success")))),
        row(span, 40, none, _event("buildFinished", empty, "finished", F.struct(F.struct(F.lit(0).alias("code")).alias("exitCode"), text(F.expr(f"(hi + {90 * _DAY}L) div 1000000")).alias("finishTimeMillis")), last=True)),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


_BUILDS = f"""WITH o AS (SELECT o_custkey AS cust, o_orderkey AS ord, epoch_us(o_orderdate::TIMESTAMP) * 1000 AS t, o_orderstatus AS st FROM orders),
b AS (SELECT cust, min(t) AS lo, max(t) + {90 * _DAY} AS hi FROM o GROUP BY 1)
"""


@query(_BUILDS + f""", l AS (SELECT cust, ord, lo, hi, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS s, epoch_us(l_shipdate::TIMESTAMP) * 1000 + {_DAY} AS e, l_returnflag AS f FROM lineitem JOIN o ON ord = l_orderkey JOIN b USING (cust))
SELECT 'c' || cust || '#1' AS inv, 'root' AS kind, 'bazel build' AS name, lo AS start_ns, hi AS end_ns, 'Ok' AS status_code FROM b
UNION ALL SELECT 'c' || cust || '#1', 'target', 'target //order:' || ord, t, CASE st WHEN 'O' THEN hi ELSE t + {60 * _DAY} END, CASE st WHEN 'F' THEN 'Ok' WHEN 'P' THEN 'Error' ELSE 'Unset' END FROM o JOIN b USING (cust)
UNION ALL SELECT 'c' || cust || '#1', 'action', 'action Ship //order:' || ord, CASE WHEN s < lo AND e <= lo THEN lo WHEN greatest(s, lo) > least(e, hi) THEN least(e, hi) ELSE greatest(s, lo) END,
  CASE WHEN s < lo AND e <= lo THEN least(lo + {_DAY}, hi) ELSE least(e, hi) END, CASE f WHEN 'R' THEN 'Error' ELSE 'Ok' END FROM l""")  # fmt: skip
def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw JSON events to spans: scan, types, windows, joins, clamps."""
    good, _ = source.classify(build_events(spark, sf_dir))
    return assemble.build(source.bronze(source.invocations(good))).select("inv", "kind", "name", "start_ns", "end_ns", "status_code")


@query(_BUILDS + """, a AS (SELECT o.cust, count(*) AS actions, count(*) FILTER (l_returnflag = 'R') AS actions_failed FROM lineitem JOIN o ON ord = l_orderkey GROUP BY 1)
SELECT 'c' || cust || '#1' AS inv, count(*) AS targets, count(*) FILTER (st = 'F') AS targets_ok, count(*) FILTER (st = 'P') AS targets_failed, coalesce(max(actions), 0)::BIGINT AS actions, coalesce(max(actions_failed), 0)::BIGINT AS actions_failed,
  'Build Summary: ' || count(*) || ' targets (' || count(*) FILTER (st = 'F') || ' ok, ' || count(*) FILTER (st = 'P') || ' failed), ' || coalesce(max(actions), 0) || ' actions (' || coalesce(max(actions_failed), 0) || ' failed), exit code 0, mode full' AS summary
FROM o LEFT JOIN a USING (cust) GROUP BY cust""")  # fmt: skip
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = source.classify(build_events(spark, sf_dir))
    return assemble.summary(source.invocations(source.parsed(good))).select("inv", "targets", "targets_ok", "targets_failed", "actions", "actions_failed", "summary")


@query("""SELECT 'c' || o_custkey || '#1' AS inv, '//order:' || o_orderkey AS label, o_orderpriority AS kind, epoch_us(o_orderdate::TIMESTAMP) * 1000 AS event_time_ns FROM orders""")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = source.classify(build_events(spark, sf_dir))
    return typed.table(source.invocations(good), "target_configured").select("inv", "label", "kind", "event_time_ns")


@query("SELECT 'v' || conv_id AS file, count(*) AS events, count(*) FILTER (role = 'assistant') AS quarantined FROM conversations GROUP BY 1")
def event_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as progress events; the assistant's lose their id and are quarantined."""
    turns = table(spark, sf_dir, "conversations")
    body = F.struct(F.col("text").alias("stdout"))
    raw = F.when(F.col("role") == "assistant", F.to_json(F.struct(body.alias("progress")))).otherwise(_event("progress", F.struct(F.col("turn").cast("string").alias("opaqueCount")), "progress", body))
    good, bad = source.classify(turns.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("seq"), raw.alias("raw")))
    both = good.select("file", F.lit(0).alias("bad")).unionByName(bad.select("file", F.lit(1).alias("bad")))
    return both.groupBy("file").agg(F.count("*").alias("events"), F.sum("bad").cast("long").alias("quarantined"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, list(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, l_linenumber, unnest(parts) AS p FROM s)
SELECT l_orderkey, l_linenumber, string_agg(DISTINCT p_name || '/' || p_partkey, ',' ORDER BY p_name || '/' || p_partkey) AS listed, count(*) AS actual FROM n JOIN part ON p_partkey = p GROUP BY 1, 2""")  # fmt: skip
def exec_log_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spawns of one log an order; output ids resolved to the log's files."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("path"))
    inv, wanted = F.col("l_orderkey").cast("string").alias("inv"), lines.select("l_orderkey", "l_partkey").distinct()
    files = wanted.join(parts, "l_partkey").select(inv, F.lit(0).cast("long").alias("seq"), F.to_json(F.struct((F.col("l_partkey") + 1).alias("id"), F.struct("path").alias("file"))).alias("raw"))
    outs = F.transform(F.array_sort(F.collect_set("l_partkey")), lambda p: F.struct((p + 1).alias("outputId")))
    spawns = lines.groupBy("l_orderkey", "l_linenumber").agg(outs.alias("outputs")).select(inv, F.col("l_linenumber").cast("long").alias("seq"), F.to_json(F.struct(F.struct("outputs", F.lit("Ship").alias("mnemonic")).alias("spawn"))).alias("raw"))
    found = exec_log.spawns(exec_log.entries(files.unionByName(spawns)))
    return found.select(F.col("inv").cast("long").alias("l_orderkey"), F.col("seq").cast("int").alias("l_linenumber"), F.array_join("listed", ",").alias("listed"), F.size("actual").cast("long").alias("actual"))


def joined_attributes(attrs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


#: Kinds of spans that no other span is under.
_LEAVES = ("spawn", "test", "fetch")


def with_parent_names(spark: SparkSession, build: Callable[[], DataFrame], *wanted: str | Column) -> DataFrame:
    """inv, kind, name, what is wanted of the spans that `build` makes, and
    parent_name. Spans are staged with these alone, and with the ids that are looked
    up; what was staged to build them goes."""
    with passing(spark) as keep:
        own = F.when(~F.col("kind").isin(*_LEAVES), F.col("span_id")).alias("own")
        spans = keep(build().select("inv", "kind", "name", own, "parent_span_id", *wanted))
    names = spans.filter("own is not null").select("inv", F.col("own").alias("parent_span_id"), F.col("name").alias("parent_name"))
    return spans.drop("own").join(names, ["inv", "parent_span_id"], "left")


@query("""WITH o AS (SELECT 'c' || o_custkey || '#1' AS inv, 'target //order:' || o_orderkey AS name, 'bazel.target.kind=' || o_orderpriority || ';bazel.target.label=//order:' || o_orderkey || ';bazel.target.label_short=//order:' || o_orderkey AS a, o_orderstatus AS st FROM orders),
l AS (SELECT 'c' || o_custkey || '#1' AS inv, 'action Ship //order:' || o_orderkey AS name, 'bazel.action.label=//order:' || o_orderkey || ';bazel.action.label_short=//order:' || o_orderkey || ';bazel.action.mnemonic=Ship;bazel.action.primary_output=' || concat_ws('-', l_linenumber, l_partkey, l_suppkey) || ';bazel.action.success=' || (l_returnflag <> 'R') AS attrs FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT inv, name, 'bazel.target.cached=true;' || a || CASE st WHEN 'F' THEN ';bazel.target.success=true' WHEN 'P' THEN ';bazel.target.success=false' ELSE '' END AS attrs FROM o UNION ALL SELECT * FROM l
UNION ALL SELECT 'c' || o_custkey || '#1', 'bazel build', 'bazel.command=build;bazel.exit_code=0;bazel.invocation_id=build-' || o_custkey FROM orders GROUP BY o_custkey""")  # fmt: skip
def event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of roots, targets and actions."""
    good, _ = source.classify(build_events(spark, sf_dir))
    return assemble.build(source.bronze(source.invocations(good))).select("inv", "name", joined_attributes(F.col("attrs")).alias("attrs"))


_HOUR = 3_600_000_000_000


def side_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build a customer: failed orders are skipped targets, open ones labels that
    are aborted by themselves, the others complete (each seventh outside); each
    order is tested once and each customer fetched once."""
    c = F.col
    text = lambda x: x.cast("string")
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"), ns("o_orderdate").alias("at"), "o_orderstatus")
    label = F.concat(F.when(c("ord") % 7 == 0, "@ext//order:").otherwise("//order:"), text(c("ord")))
    span = orders.groupBy("cust").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    empty, none = F.struct(F.lit(None).cast("string").alias("_")), F.lit(None).cast("long")
    row = lambda df, seq, at, raw: df.select(F.concat(F.lit("c"), text(c("cust"))).alias("file"), seq.cast("long").alias("seq"), at.alias("event_time_ns"), raw.alias("raw"))
    gone = F.struct(F.lit("SKIPPED").alias("reason"), F.lit("why").alias("description"))
    status = F.when(c("o_orderstatus") == "F", "PASSED").otherwise("FAILED")
    tests = F.struct(status.alias("status"), text(c("at") + _HOUR).alias("testAttemptStartNanos"), F.lit("3600s").alias("testAttemptDuration"))
    parts = [
        row(span, F.lit(0), c("lo"), _event("started", empty, "started", F.struct(F.concat(F.lit("side-"), text(c("cust"))).alias("uuid"), F.lit("test").alias("command")))),
        row(span, F.lit(1), c("lo") + c("cust"), _event("fetch", F.struct(F.concat(F.lit("u"), text(c("cust"))).alias("url")), "fetch", F.struct((c("cust") % 3 != 0).alias("success")))),
        row(orders, 10 + 4 * c("ord"), none, _event("testResult", F.struct(label.alias("label"), F.lit(1).alias("attempt")), "testResult", tests)),
        row(orders.filter("o_orderstatus = 'F'"), 11 + 4 * c("ord"), c("at") + 60 * _DAY, _event("targetCompleted", F.struct(label.alias("label")), "completed", F.struct(F.lit(True).alias("success")))),
        row(orders.filter("o_orderstatus = 'P'"), 12 + 4 * c("ord"), c("at") + 60 * _DAY, _event("targetCompleted", F.struct(label.alias("label")), "aborted", gone)),
        row(orders.filter("o_orderstatus = 'O'"), 13 + 4 * c("ord"), c("at") + 60 * _DAY, _event("configuredLabel", F.struct(label.alias("label")), "aborted", gone)),
        row(span, F.lit(2**40), none, _event("buildFinished", empty, "finished", F.struct(F.struct(F.lit(3).alias("code")).alias("exitCode"), text(F.expr(f"(hi + {90 * _DAY}L) div 1000000")).alias("finishTimeMillis")), last=True)),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    good, _ = source.classify(whole)
    return source.bronze(source.invocations(good))


_SIDE = _BUILDS + f""", s AS (SELECT 'c' || cust || '#1' AS inv, cust, ord, t, st, lo, hi, ord % 7 = 0 AS ext FROM o JOIN b USING (cust)),
x AS (SELECT inv, 'root' AS kind, 'bazel test' AS name, NULL AS parent_name, lo AS start_ns, hi AS end_ns, 'Error' AS status_code, 'exit code 3' AS status_desc FROM s GROUP BY ALL
UNION ALL SELECT inv, 'fetch', 'fetch u' || cust, 'fetches', lo + cust, lo + cust + 1000000, CASE WHEN cust % 3 = 0 THEN 'Error' ELSE 'Ok' END, CASE WHEN cust % 3 = 0 THEN 'fetch failed' END FROM s GROUP BY inv, cust, lo
UNION ALL SELECT inv, 'group', 'fetches', 'bazel test', lo + cust, hi, 'Ok', NULL FROM s GROUP BY inv, cust, lo, hi
UNION ALL SELECT inv, 'group', 'skipped targets', 'bazel test', min(t) + {60 * _DAY}, hi, 'Unset', NULL FROM s WHERE st <> 'F' GROUP BY inv, hi
UNION ALL SELECT inv, 'group', 'external deps', 'bazel test', min(t) + {_HOUR}, hi, 'Ok', NULL FROM s WHERE ext AND st <> 'P' GROUP BY inv, hi
UNION ALL SELECT inv, 'test', 'test //order:' || ord || ' [attempt=1]', 'target //order:' || ord, t + {_HOUR}, t + {2 * _HOUR}, CASE st WHEN 'F' THEN 'Ok' ELSE 'Error' END, CASE WHEN st <> 'F' THEN 'FAILED' END FROM s
UNION ALL SELECT inv, 'target', 'target //order:' || ord, CASE WHEN st = 'P' THEN 'skipped targets' WHEN ext THEN 'external deps' ELSE 'bazel test' END, t + CASE st WHEN 'P' THEN {60 * _DAY} ELSE {_HOUR} END,
  t + CASE st WHEN 'O' THEN {2 * _HOUR} ELSE {60 * _DAY} END, CASE st WHEN 'F' THEN 'Ok' ELSE 'Unset' END, NULL FROM s
UNION ALL SELECT inv, 'target', 'target //order:' || ord, 'skipped targets', NULL, t + {60 * _DAY}, 'Error', 'why' FROM s WHERE st = 'O')
"""


@query(_SIDE + "SELECT * REPLACE (coalesce(start_ns, -1) AS start_ns) FROM x")
def event_side_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests, fetches, skipped, aborted, synthetic and external targets, groups."""
    start = F.coalesce("start_ns", F.lit(-1).cast("long")).alias("start_ns")
    spans = with_parent_names(spark, lambda: assemble.build(side_events(spark, sf_dir)), start, "end_ns", "status_code", "status_desc")
    return spans.select("inv", "kind", "name", "parent_name", "start_ns", "end_ns", "status_code", "status_desc")


@query(_SIDE + """SELECT inv, name, 'bazel.target.label=' || CASE WHEN ext THEN '@ext' ELSE '' END || '//order:' || ord || ';bazel.test.attempt=1;bazel.test.status=' || CASE st WHEN 'F' THEN 'PASSED' ELSE 'FAILED' END AS attrs FROM (SELECT *, 'test //order:' || ord || ' [attempt=1]' AS name FROM s)
UNION ALL SELECT inv, 'fetch u' || cust, 'bazel.fetch.success=' || (cust % 3 <> 0) || ';bazel.fetch.url=u' || cust FROM s GROUP BY inv, cust""")  # fmt: skip
def event_side_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.build(side_events(spark, sf_dir)).filter("kind in ('test', 'fetch')").select("inv", "name", joined_attributes(F.col("attrs")).alias("attrs"))


def spawned_build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and spawns of a build a customer: every distinct line is a spawn, lines
    of number 5 and below are actions, so the others are orphans; lines with flag N
    have no spawn."""
    c, text = F.col, lambda x: x.cast("string")
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"), ns("o_orderdate").alias("at"))
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("ord"), "l_linenumber", "l_partkey", "l_suppkey").agg(F.min(ns("l_shipdate")).alias("ship"), F.min("l_returnflag").alias("flag"))
    lines = lines.join(orders.select("ord", "cust"), "ord").withColumn("seq", 1000 + (c("ord") * 16 + c("l_linenumber")) * 10**8 + c("l_partkey") * 1001 + c("l_suppkey"))
    label, output = F.concat(F.lit("//order:"), text(c("ord"))), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    span = orders.groupBy("cust").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    empty, none = F.struct(F.lit(None).cast("string").alias("_")), F.lit(None).cast("long")
    row = lambda df, seq, at, raw: df.select(F.concat(F.lit("c"), text(c("cust"))).alias("file"), seq.cast("long").alias("seq"), at.alias("event_time_ns"), raw.alias("raw"))
    body = F.struct(F.lit(True).alias("success"), F.lit("Ship").alias("type"), text(c("ship")).alias("startTimeNanos"), text(c("ship") + _DAY).alias("endTimeNanos"))
    parts = [
        row(span, F.lit(0), c("lo"), _event("started", empty, "started", F.struct(F.concat(F.lit("spawned-"), text(c("cust"))).alias("uuid"), F.lit("build").alias("command")))),
        row(span, F.lit(1), none, _event("optionsParsed", empty, "optionsParsed", F.struct(F.array(F.lit(assemble.PUBLISH)).alias("cmdLine")))),
        row(lines.filter("l_linenumber <= 5"), c("seq"), none, _event("actionCompleted", F.struct(label.alias("label"), output.alias("primaryOutput")), "action", body)),
        row(span, F.lit(2**60), none, _event("buildFinished", empty, "finished", F.struct(F.struct(F.lit(0).alias("code")).alias("exitCode"), text(F.expr(f"(hi + {90 * _DAY}L) div 1000000")).alias("finishTimeMillis")), last=True)),
    ]
    good, _ = source.classify(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    ran = lines.filter("flag <> 'N'").withColumn("inv", F.concat(F.lit("c"), text(c("cust")), F.lit("#1")))
    files = ran.select("inv", F.lit(0).cast("long").alias("seq"), F.to_json(F.struct(c("seq").alias("id"), F.struct(output.alias("path")).alias("file"))).alias("raw"))
    metrics = F.struct(F.struct(text(F.expr("ship div 1000000000")).alias("seconds")).alias("startTime"), F.lit("3600s").alias("totalTime"), F.lit("1.5s").alias("queueTime"))
    spawn = F.struct(label.alias("targetLabel"), F.lit("Ship").alias("mnemonic"), F.lit("remote").alias("runner"), (c("flag") == "A").alias("cacheHit"), F.array(F.struct(c("seq").alias("outputId"))).alias("outputs"), metrics.alias("metrics"))
    raws = ran.select("inv", "seq", F.to_json(F.struct(spawn.alias("spawn"))).alias("raw"))
    return source.bronze(source.invocations(good)), exec_log.spawns(exec_log.entries(files.unionByName(raws)))


def _clamped(s: str, e: str, lo: str, hi: str) -> tuple[str, str]:
    start = f"(CASE WHEN {s} < {lo} AND {e} <= {lo} THEN {lo} WHEN greatest({s}, {lo}) > least({e}, {hi}) THEN least({e}, {hi}) ELSE greatest({s}, {lo}) END)"
    return start, f"(CASE WHEN {s} < {lo} AND {e} <= {lo} THEN least({lo} + {e} - {s}, {hi}) ELSE least({e}, {hi}) END)"


_ACTION, _ORPHAN, _SPAWN = _clamped("ship", f"(ship + {_DAY})", "lo", "hi"), _clamped("ship", f"(ship + {_HOUR})", "lo", "hi"), _clamped("ship", f"(ship + {_HOUR})", "a_start", "a_end")


@query(_BUILDS + f""", l AS (SELECT 'c' || cust || '#1' AS inv, ord, l_linenumber AS n, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS outp, min(epoch_us(l_shipdate::TIMESTAMP) * 1000) AS ship, min(l_returnflag) AS f, lo, hi
  FROM lineitem JOIN o ON ord = l_orderkey JOIN b USING (cust) GROUP BY cust, ord, l_linenumber, l_partkey, l_suppkey, lo, hi),
a AS (SELECT *, n > 5 AS orphan, CASE WHEN n > 5 THEN {_ORPHAN[0]} ELSE {_ACTION[0]} END AS a_start, CASE WHEN n > 5 THEN {_ORPHAN[1]} ELSE {_ACTION[1]} END AS a_end FROM l WHERE n <= 5 OR f <> 'N'),
m AS (SELECT DISTINCT inv FROM l WHERE f <> 'N'),
x AS (SELECT inv, 'action' AS kind, 'action Ship //order:' || ord || CASE WHEN orphan THEN ' (synth)' ELSE '' END AS name, 'target //order:' || ord AS parent_name, a_start AS start_ns, a_end AS end_ns, CASE WHEN orphan THEN 'Unset' ELSE 'Ok' END AS status_code,
  CASE WHEN f <> 'N' THEN '1' WHEN m.inv IS NOT NULL THEN '0' END AS n_spawns, CASE WHEN f = 'N' AND m.inv IS NOT NULL THEN 'true' END AS missing, CASE WHEN f <> 'N' AND NOT orphan THEN 'remote' END AS runner, CASE WHEN f <> 'N' AND NOT orphan THEN (f = 'A')::VARCHAR END AS hit, NULL AS queue_ms, outp FROM a LEFT JOIN m USING (inv)
UNION ALL SELECT inv, 'spawn', 'spawn Ship ' || outp, 'action Ship //order:' || ord || CASE WHEN orphan THEN ' (synth)' ELSE '' END, {_SPAWN[0]}, {_SPAWN[1]}, 'Unset', NULL, NULL, 'remote', (f = 'A')::VARCHAR, '1500', outp FROM a WHERE f <> 'N') SELECT * FROM x""")  # fmt: skip
def event_spawn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions and spawns of an execution log: matches, orphans, missing ones, the
    attributes copied to actions and those of the spawns."""
    get = lambda n: F.col("attrs").getItem(f"bazel.{n}")
    act = F.col("kind") == "action"
    told = [
        get("action.spawn.count").alias("n_spawns"), get("action.spawn.missing").alias("missing"),
        F.when(act, get("action.spawn.runner")).otherwise(get("spawn.runner")).alias("runner"), F.when(act, get("action.spawn.cache_hit")).otherwise(get("spawn.cache_hit")).alias("hit"),
        get("spawn.queue_time_ms").alias("queue_ms"), F.when(act, get("action.primary_output")).otherwise(get("spawn.primary_output")).alias("outp")]
    build = lambda: assemble.build(*spawned_build(spark, sf_dir))
    spans = with_parent_names(spark, build, "start_ns", "end_ns", "status_code", *told).filter("kind in ('action', 'spawn')")
    return spans.select("inv", "kind", "name", "parent_name", "start_ns", "end_ns", "status_code", "n_spawns", "missing", "runner", "hit", "queue_ms", "outp")


@query("""WITH p AS (SELECT 'v' || conv_id || '#1' AS inv, turn AS seq, role = 'user' AS u, text FROM conversations WHERE coalesce(text, '') <> '')
SELECT inv, md5('build-' || inv) AS trace_id, seq, 'INFO' AS severity, text AS body FROM p""")  # fmt: skip
def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress as log records under the root of their build."""
    turns, file = table(spark, sf_dir, "conversations"), F.concat(F.lit("v"), F.col("conv_id").cast("string"))
    empty, user = F.struct(F.lit(None).cast("string").alias("_")), F.col("role") == "user"
    begun = turns.select(file.alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("seq"), _event("started", empty, "started", F.struct(F.concat(F.lit("build-"), F.col("file"), F.lit("#1")).alias("uuid"))).alias("raw"))
    said = turns.select(file.alias("file"), F.col("turn").alias("seq"), _event("progress", F.struct(F.col("turn").cast("string").alias("opaqueCount")), "progress", F.struct(F.when(user, F.col("text")).alias("stdout"), F.when(~user, F.col("text")).alias("stderr"))).alias("raw"))
    good, _ = source.classify(begun.unionByName(said))
    return assemble.logs(source.bronze(source.invocations(good))).select("inv", "trace_id", "seq", "severity", "body")
