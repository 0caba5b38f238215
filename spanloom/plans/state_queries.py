"""Queries of what depends on order and depth: ids written anew, trees and file
sets of many levels, early and repeated events, ends known late, caps that bite,
and traces and spawns as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assemble, traces
from ..sources import events as source
from ..sources import exec_log, sinks
from ..streaming import incremental, live
from .event_queries import _event, joined_attributes
from .kind_queries import of, stream, word
from .queries import _DAY, _TREE, query, span_tree, table

c, lit = F.col, F.lit
_LINES = "WITH l AS (SELECT l_orderkey AS ord, l_linenumber AS n, min(l_returnflag) AS f, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inv, seq, raw: an order's log. Output 1 is written at the start and by every
    line that did not come back, and every line is a spawn that uses it; numbers
    have no gaps."""
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("ord"), c("l_linenumber").alias("n")).agg(F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("part"))
    file = lambda name: F.to_json(of(id=lit(1), file=of(path=name)))
    head = lines.select("ord").distinct().select("ord", lit(0).alias("n"), lit(0).alias("k"), file(lit("first")).alias("raw"))
    written = lines.filter("f <> 'R'").select("ord", "n", lit(0).alias("k"), file(F.concat(lit("part-"), word("part"))).alias("raw"))
    used = lines.select("ord", "n", lit(1).alias("k"), F.to_json(of(spawn=of(mnemonic=word("n"), outputs=F.array(of(outputId=lit(1)))))).alias("raw"))
    place = F.row_number().over(Window.partitionBy("ord").orderBy("n", "k")) - 1
    return head.unionByName(written).unionByName(used).select(F.concat(word("ord"), lit("#1")).alias("inv"), place.cast("long").alias("seq"), "raw")


_LAST_WINS = _LINES + """ SELECT ord::VARCHAR AS ord, n::VARCHAR AS mnemonic, coalesce('part-' || last_value(CASE WHEN f <> 'R' THEN part END IGNORE NULLS) OVER (PARTITION BY ord ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'first') AS listed FROM l"""


@query(_LAST_WINS)
def log_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output id stands for what was written last before the spawn."""
    found = exec_log.spawns(exec_log.entries(log_lines(spark, sf_dir)))
    return found.select(F.regexp_replace("inv", "#1$", "").alias("ord"), "mnemonic", F.array_join("listed", ",").alias("listed"))


def _as_files(*batches: DataFrame) -> str:
    """The folder of a staged table whose rows come as that many file batches, one after the other."""
    folder = None
    for rows in batches:
        if folder is None:
            (folder,) = {f.rsplit("/", 1)[0] for f in traces.stage(rows).inputFiles()}
        else:
            rows.coalesce(1).write.mode("append").parquet(folder)
    return folder


def _streamed(out: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream that reads what is there and ends. Keyed state of many
    columns needs the RocksDB store."""
    spark, key = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").option("path", f"{folder}-out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(f"{folder}-out")


@query(_LAST_WINS)
def streamed_spawns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream: lines in no order, keyed state of what an id stands for."""
    lines = log_lines(spark, sf_dir).select("inv", "seq", F.timestamp_seconds(lit(10**9)).alias("at"), "raw")
    folder = _as_files(lines.repartition(8, F.xxhash64("raw")))
    spawns = incremental.log_spawns(incremental.read_lines(spark, folder, 8)).select("inv", "mnemonic", "listed")
    return _streamed(spawns, folder).select(F.regexp_replace("inv", "#1$", "").alias("ord"), "mnemonic", F.array_join("listed", ",").alias("listed"))


def small_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, seq, event_time_ns, raw: a supplier's build; its nation's region is the
    target, suppliers tell tests and fetches. Numbers have no gaps."""
    s = table(spark, sf_dir, "supplier")
    file, at = F.concat(lit("s"), word("s_suppkey")).alias("file"), lambda n: lit(n * 10**9).cast("long").alias("event_time_ns")
    label = F.concat(lit("//n:"), word("s_nationkey"))
    row = lambda seq, when, raw: s.select(file, lit(seq).cast("long").alias("seq"), at(when), raw.alias("raw"))
    action = lambda output, start: _event("actionCompleted", of(label=label, primaryOutput=lit(output)), "action", of(success=lit(True), type=lit("T"), startTimeNanos=lit(start * 10**9).cast("string"), endTimeNanos=lit((start + 5) * 10**9).cast("string")))
    parts = [
        row(0, 5, _event("fetch", of(url=lit("early")), "fetch", of(success=lit(True)))),
        row(1, 10, _event("started", of(_=lit(None).cast("string")), "started", of(uuid=F.concat(lit("b"), word("s_suppkey")), command=lit("build")))),
        row(2, 10, _event("optionsParsed", of(_=lit(None).cast("string")), "optionsParsed", of(cmdLine=F.array(lit(assemble.PUBLISH), lit("--execution_log_compact_file=/l"))))),
        row(3, 11, _event("targetConfigured", of(label=label), "configured", of(targetKind=lit("k")))),
        row(4, 12, action("a", 12)),
        row(5, 13, _event("testResult", of(label=label, attempt=lit(1)), "testResult", of(status=lit("PASSED"), testAttemptStartNanos=lit("13000000000"), testAttemptDurationNanos=lit("1000000000")))),
        row(6, 20, _event("targetCompleted", of(label=label), "completed", of(success=lit(False)))),
        row(7, 21, _event("targetCompleted", of(label=label), "completed", of(success=lit(True)))),
        row(8, 22, _event("buildMetrics", of(_=lit(None).cast("string")), "buildMetrics", of(timingMetrics=of(wallTimeInMs=lit("15000"))))),
        row(9, 23, action("b", 23)),
        row(10, 24, _event("buildFinished", of(_=lit(None).cast("string")), "finished", of(exitCode=of(code=lit(0))), last=True)),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def small_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inv, seq, raw: two spawns of the first action for every third supplier, and one without an action."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0")
    label = F.concat(lit("//n:"), word("s_nationkey"))
    spawn = lambda n, start: of(spawn=of(targetLabel=label, mnemonic=lit("T"), runner=lit(f"r{start}"), outputs=F.array(of(outputId=lit(n))), metrics=of(startTime=of(seconds=lit(str(start))), totalTime=lit("1s"))))
    rows = [of(id=lit(1), file=of(path=lit("a"))), spawn(1, 13), spawn(1, 14), of(id=lit(2), file=of(path=lit("lone"))), spawn(2, 15)]
    inv, parts = F.concat(lit("s"), word("s_suppkey"), lit("#1")).alias("inv"), None
    for n, raw in enumerate(rows):
        part = s.select(inv, lit(n).cast("long").alias("seq"), F.to_json(raw).alias("raw"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


#: Bounds are those known at each event: the end at 25 s is told by the metrics, after the first action.
_SMALL = """WITH s AS (SELECT 's' || s_suppkey || '#1' AS inv, '//n:' || s_nationkey AS l, s_suppkey % 3 = 0 AS logged FROM supplier),
x AS (SELECT inv, 'root' AS kind, 'bazel build' AS name, NULL AS parent_name, 10 AS a, 25 AS b, 'Ok' AS status_code, NULL AS spawns, NULL AS runner FROM s
UNION ALL SELECT inv, 'group', 'fetches', 'bazel build', 5, 25, 'Ok', NULL, NULL FROM s
UNION ALL SELECT inv, 'fetch', 'fetch early', 'fetches', 5, 5, 'Ok', NULL, NULL FROM s
UNION ALL SELECT inv, 'target', 'target ' || l, 'bazel build', 11, 21, 'Ok', NULL, NULL FROM s
UNION ALL SELECT inv, 'action', 'action T ' || l, 'target ' || l, 12, 17, 'Ok', CASE WHEN logged THEN '2' END, CASE WHEN logged THEN 'r13' END FROM s
UNION ALL SELECT inv, 'action', 'action T ' || l, 'target ' || l, 23, 25, 'Ok', CASE WHEN logged THEN '0' END, NULL FROM s
UNION ALL SELECT inv, 'test', 'test ' || l || ' [attempt=1]', 'target ' || l, 13, 14, 'Ok', NULL, NULL FROM s
UNION ALL SELECT inv, 'action', 'action T ' || l || ' (synth)', 'target ' || l, 15, 16, 'Unset', '1', NULL FROM s WHERE logged
UNION ALL SELECT inv, 'spawn', 'spawn T a', 'action T ' || l, n, n + 1, 'Unset', NULL, 'r' || n FROM s, (VALUES (13), (14)) v(n) WHERE logged
UNION ALL SELECT inv, 'spawn', 'spawn T lone', 'action T ' || l || ' (synth)', 15, 16, 'Unset', NULL, 'r15' FROM s WHERE logged)
SELECT inv, kind, name, parent_name, a::BIGINT * 1000000000 AS start_ns, b::BIGINT * 1000000000 + CASE kind WHEN 'fetch' THEN 1000000 ELSE 0 END AS end_ns, status_code, spawns, runner FROM x"""


def _told(spans: DataFrame) -> DataFrame:
    spans = traces.stage(spans)
    names = spans.select("inv", c("span_id").alias("parent_span_id"), c("name").alias("parent_name"))
    get = lambda n: c("attrs").getItem(f"bazel.{n}")
    runner = F.when(c("kind") == "spawn", get("spawn.runner")).otherwise(get("action.spawn.runner"))
    return spans.join(names, ["inv", "parent_span_id"], "left").select("inv", "kind", "name", "parent_name", "start_ns", "end_ns", "status_code", get("action.spawn.count").alias("spawns"), runner.alias("runner"))


@query(_SMALL)
def clamp_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early fetches, a target that completes twice, spans bound by the end only once it is known."""
    good, _ = source.classify(small_builds(spark, sf_dir))
    spawns = exec_log.spawns(exec_log.entries(small_logs(spark, sf_dir)))
    return _told(assemble.build(source.bronze(source.invocations(good)), spawns, assemble.Options(clamp="as_of")))


@query(_SMALL)
def streamed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same builds and logs as streams: keyed state hands spans on one by one,
    spawns wait for their action, and the rest goes out at the end."""
    began = F.timestamp_seconds(lit(10**9))
    events = small_builds(spark, sf_dir).select("file", "seq", began.alias("at"), "event_time_ns", "raw")
    lines = small_logs(spark, sf_dir).select("inv", "seq", began.alias("at"), "raw")
    beat = lambda n: spark.range(1).select(lit("beat").alias("file"), lit(n).cast("long").alias("seq"), F.timestamp_seconds(lit(10**9 + 7200 * n)).alias("at"), lit(None).cast("long").alias("event_time_ns"), lit('{"id": {"progress": {}}}').alias("raw"))
    folder, log_folder = _as_files(events.filter("seq % 2 = 1").coalesce(1), events.filter("seq % 2 = 0"), beat(0), beat(1), beat(2)), _as_files(lines.coalesce(1))
    schema = "file string, seq long, at timestamp, event_time_ns long, raw string"
    feed = live.read_events(spark, folder, 1, schema)
    handed = _streamed(incremental.handed_on(feed, incremental.read_lines(spark, log_folder, 1), delay="1 seconds"), folder)
    return _told(incremental.spans_of(handed.filter("inv not like 'beat#%'")))


@query("""WITH o AS (SELECT o_custkey AS cust, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT cust, ord, CASE WHEN cust % 4 <> 0 OR n = 1 THEN r::INT - 1 END AS depth, r::INT AS place FROM o""")  # fmt: skip
def deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a chain, as deep as there are orders; every fourth
    customer's chain is bent into a ring, which no root is over."""
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"))
    along = Window.partitionBy("cust").orderBy("ord")
    first, last = F.col("before").isNull(), F.max("ord").over(Window.partitionBy("cust"))
    linked = orders.withColumn("before", F.lag("ord").over(along)).withColumn("last", last)
    up = F.when(first & (c("cust") % 4 == 0) & (c("last") != c("ord")), c("last")).otherwise(c("before"))
    return traces.tree_order(linked.select("cust", "ord", up.alias("up"), lit(None).cast("long").alias("none")), "cust", "ord", "up", "ord", "none").select("cust", "ord", "depth", "place")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS cust, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
t AS (SELECT cust, r AS root, r AS node, 0 AS depth FROM o UNION ALL SELECT t.cust, t.root, o.r, t.depth + 1 FROM t JOIN o ON o.cust = t.cust AND (o.r = 2 * t.node OR o.r = 2 * t.node + 1)),
f AS (SELECT t.cust, root, 'f' || o.ord AS file, row_number() OVER (PARTITION BY t.cust, root ORDER BY depth, 's' || node) AS n FROM t JOIN o ON o.cust = t.cust AND o.r = t.node),
g AS (SELECT cust, root, count(*) AS total, string_agg(file, ', ' ORDER BY n) FILTER (n <= 20) AS shown FROM f GROUP BY 1, 2)
SELECT 'c' || g.cust || '#1' AS inv, 'target //order:' || o.ord AS name, total::VARCHAR AS output_count, shown || CASE WHEN total > 20 THEN ', ... and ' || (total - 20) || ' more' ELSE '' END AS output_files FROM g JOIN o ON o.cust = g.cust AND o.r = g.root""")  # fmt: skip
def target_output_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the whole assembly: a customer's orders are targets, and their file
    sets a binary tree; files come by depth, then set, the first twenty of them."""
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("cust"), c("o_orderkey").alias("ord"))
    ranked = orders.withColumn("r", F.row_number().over(Window.partitionBy("cust").orderBy("ord")))
    sizes = ranked.groupBy("cust").agg(F.max("r").alias("n"))
    name, empty = lambda r: F.concat(lit("s"), r.cast("string")), of(_=lit(None).cast("string"))
    sets = ranked.join(sizes, "cust")
    below = F.filter(F.array(2 * c("r"), 2 * c("r") + 1), lambda x: x <= c("n"))
    file = F.concat(lit("c"), word("cust")).alias("file")
    parts = [
        sizes.select(file, lit(0).cast("long").alias("seq"), _event("started", empty, "started", of(uuid=F.concat(lit("u"), word("cust")), command=lit("build"))).alias("raw")),
        sets.select(file, lit(1).cast("long").alias("seq"), _event("namedSet", of(id=name(c("r"))), "namedSetOfFiles", of(files=F.array(of(name=F.concat(lit("f"), word("ord")))), fileSets=F.transform(below, lambda x: of(id=name(x))))).alias("raw")),
        sets.select(file, (lit(2) + c("r")).cast("long").alias("seq"), _event("targetCompleted", of(label=F.concat(lit("//order:"), word("ord"))), "completed", of(success=lit(True), outputGroup=F.array(of(fileSets=F.array(of(id=name(c("r")))))))).alias("raw")),
    ]
    good, _ = source.classify(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    spans = assemble.build(source.bronze(source.invocations(good))).filter("kind = 'target'")
    get = lambda n: c("attrs").getItem(f"bazel.target.{n}")
    return spans.select("inv", "name", get("output_count").alias("output_count"), get("output_files").alias("output_files"))


@query("""SELECT s_suppkey || '#1' AS inv, 'bazel.command=build;bazel.command_line=build --action_env=TOKEN=***;bazel.invocation_id=i' || s_suppkey || ';bazel.metadata.API_TOKEN=***;bazel.metadata.phase=p' || s_nationkey
  || ';bazel.workspace.build_secret=***;bazel.workspace.host=h' || s_nationkey || ';bazel.workspace.user=' || s_name AS attrs FROM supplier""")  # fmt: skip
def root_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines, workspace status and metadata on the root, secrets hidden by
    their names; a later event wins."""
    s, empty = table(spark, sf_dir, "supplier"), of(_=lit(None).cast("string"))
    item = lambda k, v: of(key=lit(k), value=v)
    rows = [
        _event("started", empty, "started", of(uuid=F.concat(lit("i"), word("s_suppkey")), command=lit("build"), user=lit("early"))),
        _event("unstructuredCommandLine", empty, "unstructuredCommandLine", of(args=F.array(lit("build"), F.concat(lit("--action_env=TOKEN="), word("s_acctbal"))))),
        _event("workspaceStatus", empty, "workspaceStatus", of(item=F.array(item("BUILD_USER", c("s_name")), item("BUILD_HOST", F.concat(lit("h"), word("s_nationkey"))), item("BUILD_SECRET", word("s_acctbal")), item("", lit("x"))))),
        _event("buildMetadata", empty, "buildMetadata", of(metadata=F.create_map(lit("phase"), F.concat(lit("p"), word("s_nationkey")), lit("API_TOKEN"), word("s_acctbal")))),
    ]
    numbered = s.select("s_suppkey", F.posexplode(F.array(*rows)).alias("seq", "raw"))
    told = assemble.root_attributes(stream(numbered, c("s_suppkey"), c("seq"), c("raw")))
    return told.select("inv", joined_attributes(c("attrs")).alias("attrs"))


@query("""WITH d AS (SELECT source, max(octet_length(encode(text))) AS most, sum(octet_length(encode(text))) AS total FROM documents GROUP BY 1)
SELECT source, count(*) AS kept FROM documents JOIN d USING (source) WHERE most <= 12000 AND total <= 120000 GROUP BY 1""")  # fmt: skip
def size_caps_bite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps that most tables exceed: logs with a long entry or a long whole go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source.enforce_caps(docs, ["source"], "text", ["doc_id"], entry_bytes=12_000, total_bytes=120_000).groupBy("source").agg(F.count("*").alias("kept"))


@query(_TREE + f""" SELECT strftime(make_timestamp(start_ns % {20 * _DAY} // 1000), '%Y-%m-%d') AS day, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM t GROUP BY 1""")
def spans_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written by day of their start, and read back by it; all are moved into twenty days."""
    spans = span_tree(spark, sf_dir).withColumn("start_ns", c("start_ns") % (20 * _DAY))
    (folder,) = {f.rsplit("/", 1)[0] for f in traces.stage(spark.range(1)).inputFiles()}
    sinks.write_spans(spans, f"{folder}-spans")
    back = spark.read.parquet(f"{folder}-spans")
    return back.groupBy(c("build_date").cast("string").alias("day")).agg(F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"))
