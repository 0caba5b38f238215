"""The operators over the given tables: orders stand for targets, lines for actions
and spawns, users' events for build events. Each query reads whole tables and has
the SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, labels, redact, status, text, times
from ..operators import ordered, traces

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str):
    return (F.unix_micros(F.col(column).cast("timestamp")) * 1000).cast("long")


ORDER = ["ts", "event_id"]
_EVENTS = "WITH e AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS invocation FROM events)"


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.split_invocations(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "signup", ORDER)


@query(_EVENTS + " SELECT user_id, event_id, invocation::BIGINT AS invocation FROM e")
def invocation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invocations(spark, sf_dir).select("user_id", "event_id", "invocation")


@query(_EVENTS + """, m AS (SELECT *, last_value(CASE event_type WHEN 'purchase' THEN 'full' WHEN 'view' THEN 'lightweight' WHEN 'signup' THEN 'lightweight' END IGNORE NULLS)
  OVER (PARTITION BY user_id, invocation ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mode FROM e)
SELECT user_id, event_id, coalesce(mode, 'lightweight') AS mode FROM m WHERE event_type = 'error' OR event_type = 'click' AND mode = 'full'""")  # fmt: skip
def action_mode_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed actions always, others while the mode in force is full."""
    said = F.when(F.col("event_type") == "purchase", "full").when(F.col("event_type").isin("view", "signup"), "lightweight")
    known = ordered.as_of(invocations(spark, sf_dir), ["user_id", "invocation"], said, ORDER, "mode").withColumn("mode", F.coalesce("mode", F.lit("lightweight")))
    return known.filter("event_type = 'error' or event_type = 'click' and mode = 'full'").select("user_id", "event_id", "mode")


@query(_EVENTS + """, c AS (SELECT *, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, invocation ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM e)
SELECT user_id, invocation::BIGINT AS invocation, event_id FROM c WHERE closed = 0""")  # fmt: skip
def cut_after_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.cut_after_last(invocations(spark, sf_dir), ["user_id", "invocation"], F.col("event_type") == "purchase", ORDER).select("user_id", "invocation", "event_id")


@query("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, props IS NULL OR json_extract_string(props, '$.k') IS NULL AS missing FROM events")
def event_payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), k.isNull().alias("missing"))


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS targets, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS targets_ok,
  count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'P') AS targets_failed, count(l_orderkey) AS actions, count(l_orderkey) FILTER (l_returnflag = 'R') AS actions_failed
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")  # fmt: skip
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are counted per order first, so the join has a row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return orders.join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(
        F.count("*").alias("targets"), F.count_if(F.col("o_orderstatus") == "F").alias("targets_ok"), F.count_if(F.col("o_orderstatus") == "P").alias("targets_failed"),
        zero("n").alias("actions"), zero("bad").alias("actions_failed"))


@query("""WITH d AS (SELECT l_orderkey AS label, max(epoch_us(l_shipdate::TIMESTAMP) * 1000) AS completed_ns, bool_and(l_returnflag <> 'R') AS success FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
c AS (SELECT o_orderkey AS label, o_orderpriority AS kind FROM orders WHERE o_orderstatus <> 'P')
SELECT label, kind, coalesce(completed_ns, 0) AS completed_ns, coalesce(success, false) AS success, CASE WHEN c.label IS NOT NULL AND d.label IS NOT NULL THEN 'done' WHEN c.label IS NOT NULL THEN 'open' ELSE 'unknown' END AS state
FROM (SELECT label FROM c UNION SELECT label FROM d) LEFT JOIN c USING (label) LEFT JOIN d USING (label)""")  # fmt: skip
def target_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("label")).agg(F.max(ns("l_shipdate")).alias("completed_ns"), F.bool_and(F.col("l_returnflag") != "R").alias("success"))
    known = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("label"), F.col("o_orderpriority").alias("kind"))
    found = traces.lifecycle(known, done, ["label"])
    return found.withColumns({"completed_ns": F.coalesce("completed_ns", F.lit(0).cast("long")), "success": F.coalesce("success", F.lit(False))})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(o_orderkey, -1) AS parent, o_orderkey IS NULL AS synthetic
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F')) ON o_orderkey = l_orderkey""")  # fmt: skip
def action_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the labels differ from their target's by leading marks."""
    mark = lambda key, odd: F.concat(F.when(F.col(key) % 2 == odd, "@@").otherwise(""), F.lit("//order:"), F.col(key).cast("string"))
    targets = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F")).select(mark("o_orderkey", 0).alias("target"), "o_orderkey", F.lit(0).alias("inv"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mark("l_orderkey", 1).alias("label"), F.lit(0).alias("inv"))
    return traces.parents(lines, targets, ["inv"], "label", "target", "o_orderkey").drop("label", "inv").withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@query("""SELECT l_orderkey AS label, arg_min(epoch_us(l_shipdate::TIMESTAMP) * 1000, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS start_ns, max(epoch_us(l_shipdate::TIMESTAMP) * 1000) AS end_ns, count(*) AS children
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY 1""")  # fmt: skip
def synthetic_target_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target known by its children alone: the first child's start, the last end."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    absent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    timed = lines.join(absent, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("label"), ns("l_shipdate").alias("at"), at.alias("seq"))
    return traces.child_bounds(timed, ["label"], "at", "at", F.col("seq")).withColumnsRenamed({"child_start": "start_ns", "child_end": "end_ns"})


_DAY = 86_400_000_000_000


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS s, epoch_us(l_shipdate::TIMESTAMP) * 1000 + l_quantity::BIGINT * {_DAY} AS e,
  epoch_us(o_orderdate::TIMESTAMP) * 1000 AS lo, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate::TIMESTAMP) * 1000 + 30 * {_DAY} END AS hi FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT *, s < lo AND e <= lo AS moved, greatest(s, lo) AS cs, CASE WHEN hi IS NULL THEN e ELSE least(e, hi) END AS ce FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN moved THEN lo WHEN cs > ce THEN ce ELSE cs END AS start_ns,
  CASE WHEN moved THEN greatest(CASE WHEN hi IS NULL THEN lo + greatest(e - s, 0) ELSE least(lo + greatest(e - s, 0), hi) END, lo) ELSE ce END AS end_ns FROM x""")  # fmt: skip
def clamp_to_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ns("l_shipdate").alias("start_ns"), (ns("l_shipdate") + F.col("l_quantity").cast("long") * _DAY).alias("end_ns"))
    bounds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), ns("o_orderdate").alias("lo"), F.when(F.col("o_orderstatus") != "O", ns("o_orderdate") + 30 * _DAY).alias("hi"))
    return traces.clamp_columns(lines.join(bounds, "l_orderkey"), "start_ns", "end_ns", "lo", "hi").drop("lo", "hi")


_SPAWNS = """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL),
a AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE l_partkey END AS output FROM lineitem WHERE l_linenumber <= 3),
t AS (SELECT s.*, 0 AS rank, l_partkey AS output FROM s UNION ALL SELECT s.*, 1, l_suppkey FROM s WHERE l_suppkey <> l_partkey),
m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min((rank, output)) AS best FROM t JOIN a USING (l_orderkey, output) GROUP BY ALL)
"""


def _spawns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    spawns = lines.groupBy(*key).agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    word = lambda c: F.col(c).cast("string")
    spawns = spawns.withColumn("candidates", labels.spawn_candidates(F.array(word("l_partkey")), F.array(word("l_suppkey"))))
    output = F.when(F.col("l_partkey") % 3 == 0, word("l_suppkey")).otherwise(word("l_partkey"))
    actions = lines.filter("l_linenumber <= 3").select("l_orderkey", output.alias("output")).distinct().withColumn("action", F.col("output"))
    return spawns, actions, traces.match_ranked(spawns, actions, ["l_orderkey"], key, "candidates", ["l_orderkey"], "output", "action")


@query(_SPAWNS + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, best[1]::BIGINT AS rank, best[2]::BIGINT AS action FROM m")
def spawn_match_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, matched = _spawns(spark, sf_dir)
    return matched.withColumns({"action": F.col("action").cast("long"), "rank": F.col("rank").cast("long")})


@query(_SPAWNS + """SELECT l_orderkey, epoch_us(min(first_ship)::TIMESTAMP) * 1000 AS start_ns, epoch_us(max(last_ship)::TIMESTAMP) * 1000 AS end_ns, count(*) AS spawns,
  arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS label FROM s ANTI JOIN m USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1""")  # fmt: skip
def spawn_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spawns, _, matched = _spawns(spark, sf_dir)
    timed = spawns.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ns("first_ship").alias("s"), ns("last_ship").alias("e"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return traces.orphans(timed, matched, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"], "s", "e", "l_partkey", "seq")


@query("SELECT o_orderkey, count(l_orderkey) AS spawn_count, count(l_orderkey) = 0 AS spawn_missing FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def actions_without_spawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    spawns = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return traces.spawn_summary(table(spark, sf_dir, "orders").select("o_orderkey"), spawns, ["o_orderkey"])


_ALL = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS n, count(*) OVER (PARTITION BY l_orderkey) AS spawn_count FROM lineitem)
SELECT l_orderkey, spawn_count, l_linenumber, l_partkey, l_returnflag FROM r WHERE n = 1""")  # fmt: skip
def first_spawn_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.first_spawn(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in _ALL.split(", ")], "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT s_suppkey, s_nationkey, coalesce(n_name, s_nationkey::VARCHAR) AS configuration FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON n_nationkey = s_nationkey")
def config_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a key, or the key itself where it has none."""
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return traces.named(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, [], "s_nationkey", "n_name", "configuration")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || c_custkey, 's' || c_mktsegment FROM customer
  UNION SELECT 's' || c_mktsegment, 'r0' FROM customer WHERE c_mktsegment = 'BUILDING'),
t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node FROM region UNION SELECT root, b FROM t JOIN e ON a = node) SELECT root, count(*) AS reached, count(*) FILTER (node[1] = 'c') AS files FROM t GROUP BY 1""")  # fmt: skip
def output_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability through diamonds (segments) and a cycle back to a region."""
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nations.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    edges = edges.union(customers.select(name("n", "c_nationkey"), name("c", "c_custkey"))).union(customers.select(name("c", "c_custkey"), name("s", "c_mktsegment")))
    edges = edges.union(customers.filter("c_mktsegment = 'BUILDING'").select(name("s", "c_mktsegment"), F.lit("r0")))
    reached = traces.closure(edges, table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("r")), "a", "b", "r")
    return reached.groupBy("root").agg(F.count("*").alias("reached"), F.count_if(F.startswith("node", F.lit("c"))).alias("files"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return ordered.latest(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""WITH l AS (SELECT user_id, event_type AS key, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
SELECT user_id, string_agg(key || '=' || value, ';' ORDER BY key) AS attrs FROM l GROUP BY 1""")  # fmt: skip
def root_attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.struct("ts", "event_id").alias("seq"))
    merged = ordered.merge_attributes(writes, ["user_id"])
    return merged.select("user_id", F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attrs"))


@query("""WITH p AS (SELECT DISTINCT p_brand, p_name FROM part), l AS (SELECT p_brand, list(p_name ORDER BY p_name) AS names FROM p GROUP BY 1)
SELECT p_brand, len(names) AS output_count, array_to_string(names[1:20], ', ') || CASE WHEN len(names) > 20 THEN ', ... and ' || (len(names) - 20) || ' more' ELSE '' END AS output_files FROM l""")  # fmt: skip
def target_outputs_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    listed = traces.first_and_total(rows, ["p_brand"], "p_name", ["p_name"], 20)
    return listed.select("p_brand", F.col("total").alias("output_count"), text.first_and_count(F.col("shown"), 20, total=F.col("total")).alias("output_files"))


def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as builds, orders as targets, lines as actions: one row a span,
    children fitted into their parents."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("cust"), ns("o_orderdate").alias("o_start"), F.col("o_orderstatus").alias("o_status"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_linenumber", "l_partkey", "l_suppkey", ns("l_shipdate").alias("start_ns"), F.col("l_returnflag").alias("flag"))
    trace = ids.trace_id(F.concat(F.lit("build-"), F.col("cust").cast("string")))
    target = lambda: ids.span_id(trace, "target", F.col("ord"))
    root = lambda: ids.span_id(trace, "root")
    none = F.lit(None)
    roots = customers.join(orders.groupBy("cust").agg(F.min("o_start").alias("s"), F.max("o_start").alias("e")), "cust", "left")
    root_rows = roots.select(trace.alias("trace_id"), root().alias("span_id"), none.cast("string").alias("parent_span_id"), F.lit("root").alias("kind"), F.concat(F.lit("bazel build "), F.col("cust").cast("string")).alias("name"), F.coalesce("s", F.lit(0).cast("long")).alias("start_ns"), (F.coalesce("e", F.lit(0).cast("long")) + 90 * _DAY).alias("end_ns"), F.lit(status.UNSET).alias("status"))
    ok = status.success_status(F.when(F.col("o_status") == "F", True).when(F.col("o_status") == "P", False), "target failed")["code"]
    target_rows = orders.select(trace, target(), root(), F.lit("target"), F.concat(F.lit("target //order:"), F.col("ord").cast("string")), "o_start", F.col("o_start") + 60 * _DAY, ok)
    inner = lines.join(orders.select("ord", "cust", "o_start"), "ord").withColumn("end_ns", F.col("start_ns") + _DAY).withColumn("hi", F.col("o_start") + 60 * _DAY)
    inner = traces.clamp_columns(inner, "start_ns", "end_ns", "o_start", "hi")
    done = status.success_status(F.col("flag") != "R", "Action failed")["code"]
    action_rows = inner.select(trace, ids.span_id(trace, "action", F.col("ord"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")), target(), F.lit("action"), labels.action_name(F.lit("Ship"), F.concat(F.lit("//order:"), F.col("ord").cast("string"))), "start_ns", "end_ns", done)
    return root_rows.union(target_rows).union(action_rows)


_TREE = f"""WITH k AS (SELECT c_custkey AS cust, md5('build-' || c_custkey) AS trace FROM customer),
o AS (SELECT o_orderkey AS ord, trace, epoch_us(o_orderdate::TIMESTAMP) * 1000 AS s, o_orderstatus AS st, substr(sha256(trace || chr(1) || 'target' || chr(1) || o_orderkey), 1, 16) AS id, substr(sha256(trace || chr(1) || 'root'), 1, 16) AS root, cust FROM orders JOIN k ON cust = o_custkey),
l AS (SELECT o.*, l_linenumber AS ln, l_partkey AS p, l_suppkey AS q, l_returnflag AS f, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS ls FROM lineitem JOIN o ON ord = l_orderkey),
t AS (SELECT trace AS trace_id, substr(sha256(trace || chr(1) || 'root'), 1, 16) AS span_id, NULL AS parent_span_id, 'root' AS kind, 'bazel build ' || k.cust AS name, coalesce(min(s), 0) AS start_ns, coalesce(max(s), 0) + {90 * _DAY} AS end_ns, 'Unset' AS status FROM k LEFT JOIN o USING (trace) GROUP BY ALL
UNION ALL SELECT trace, id, root, 'target', 'target //order:' || ord, s, s + {60 * _DAY}, CASE st WHEN 'F' THEN 'Ok' WHEN 'P' THEN 'Error' ELSE 'Unset' END FROM o
UNION ALL SELECT trace, substr(sha256(trace || chr(1) || 'action' || chr(1) || ord || chr(1) || ln || chr(1) || p || chr(1) || q), 1, 16), id, 'action', 'action Ship //order:' || ord,
  CASE WHEN ls + {_DAY} <= s THEN s WHEN greatest(ls, s) > least(ls + {_DAY}, s + {60 * _DAY}) THEN least(ls + {_DAY}, s + {60 * _DAY}) ELSE greatest(ls, s) END,
  CASE WHEN ls + {_DAY} <= s THEN s + {_DAY} ELSE least(ls + {_DAY}, s + {60 * _DAY}) END, CASE f WHEN 'R' THEN 'Error' ELSE 'Ok' END FROM l)
"""


@query(_TREE + "SELECT * FROM t")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_tree(spark, sf_dir)


@query(_TREE + "SELECT trace_id, count(*) AS span_count, bool_or(parent_span_id IS NULL) AS has_root, 0::BIGINT AS dangling FROM t GROUP BY 1")
def trace_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_check(span_tree(spark, sf_dir), "trace_id", "span_id", "parent_span_id", "name", "bazel")


@query("SELECT o_custkey AS invocation, CASE o_orderstatus WHEN 'F' THEN 'fetches' WHEN 'P' THEN 'skipped targets' ELSE 'external deps' END AS group_name, min(epoch_us(o_orderdate::TIMESTAMP) * 1000) AS first FROM orders GROUP BY 1, 2")
def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "F", "fetches").when(F.col("o_orderstatus") == "P", "skipped targets").otherwise("external deps")
    children = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("invocation"), name.alias("group_name"), ns("o_orderdate").alias("start_ns"))
    return traces.groups(children, ["invocation"], "group_name", "start_ns")


@query("""SELECT conv_id, turn, '--action_env=' || CASE turn % 3 WHEN 0 THEN 'API_token' WHEN 1 THEN 'PATH' ELSE 'db_Password' END || '=' || CASE turn % 3 WHEN 1 THEN text ELSE '***' END AS secret_arg,
  '--other=TOKEN=' || role AS plain_arg, '--define=TOKEN' AS bare_arg FROM conversations""")  # fmt: skip
def redact_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("turn") % 3 == 0, "API_token").when(F.col("turn") % 3 == 1, "PATH").otherwise("db_Password")
    args = F.array(F.concat(F.lit("--action_env="), name, F.lit("="), "text"), F.concat(F.lit("--other=TOKEN="), "role"), F.lit("--define=TOKEN"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", args.alias("args"))
    clean, _ = redact.redact_table(rows, args=("args",))
    return clean.select("conv_id", "turn", F.col("args")[0].alias("secret_arg"), F.col("args")[1].alias("plain_arg"), F.col("args")[2].alias("bare_arg"))


@query("""SELECT doc_id, 'run --test_env=MY_SECRET=*** ' || text || chr(10) || '--define=user_auth=***' || chr(9) || '--client_env=HOME=' || lang || ' --repo_env=COOKIE' AS body FROM documents""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("run --test_env=MY_SECRET="), F.col("source"), F.lit(" "), F.col("text"), F.lit("\n--define=user_auth="), F.col("source"), F.lit("\t--client_env=HOME="), F.col("lang"), F.lit(" --repo_env=COOKIE"))
    clean, _ = redact.redact_table(table(spark, sf_dir, "documents").select("doc_id", body.alias("body")), texts=("body",))
    return clean


@query("SELECT conv_id, turn, role, text || role || 'x' AS clean FROM conversations")
def strip_ansi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    esc = "\x1b"
    log = F.concat(F.lit(f"{esc}[1;31m"), "text", F.lit(f"{esc}[0m{esc}]0;title\x07"), "role", F.lit(f"{esc}]8;;u{esc}\\{esc}Mx{esc}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.strip_ansi(log).alias("clean"))


@query("""WITH b AS (SELECT doc_id, text, encode(text) AS d FROM documents),
c AS (SELECT *, CASE WHEN octet_length(d) <= 4096 THEN NULL ELSE (SELECT max(k) FROM range(4093, 4097) r(k) WHERE NOT (hex(d[k + 1:k + 1]) BETWEEN '80' AND 'BF')) END AS cut FROM b)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE decode(d[1:cut]) || '...' END AS short FROM c""")  # fmt: skip
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_bytes(F.col("text"), 4096, "...").alias("short"))


@query("""WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '@@//' WHEN 1 THEN '@repo' || p_size || '//' WHEN 2 THEN '@only' ELSE '//' END || p_name AS label FROM part)
SELECT p_partkey, ltrim(label, '@') AS normal, CASE WHEN label LIKE '@@%' THEN substr(label, 3) WHEN label LIKE '@%//%' THEN substr(label, instr(label, '//')) ELSE label END AS short, label LIKE '@%' AS external FROM l""")  # fmt: skip
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 4
    label = F.concat(F.when(n == 0, "@@//").when(n == 1, F.concat(F.lit("@repo"), F.col("p_size").cast("string"), F.lit("//"))).when(n == 2, "@only").otherwise("//"), "p_name")
    rows = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    return rows.select("p_partkey", labels.normalize_label(F.col("label")).alias("normal"), labels.shorten_label(F.col("label")).alias("short"), labels.is_external(F.col("label")).alias("external"))


@query(f"""WITH d AS (SELECT o_orderpriority, l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate::TIMESTAMP) * 1000 - epoch_us(o_orderdate::TIMESTAMP) * 1000 AS duration_ns FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY duration_ns DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM d) SELECT * FROM r WHERE rank <= 5""")
def slowest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ns("l_shipdate").alias("e"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", ns("o_orderdate").alias("s"))
    timed = lines.join(orders, "l_orderkey").withColumn("duration_ns", F.col("e") - F.col("s")).drop("e", "s")
    return ordered.slowest(timed, ["o_orderpriority"], F.col("duration_ns"), 5, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH n AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY p_name) AS outputs, count(*) AS listed FROM n GROUP BY 1""")
def spawn_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    joined = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(names, "l_partkey")
    listed = F.array_sort(F.collect_set("p_name"))
    return joined.groupBy("l_orderkey").agg(F.array_join(listed, ", ").alias("outputs"), F.size(listed).cast("long").alias("listed"))


@query("""WITH s AS (SELECT s_nationkey, list_extract(['NO_STATUS', 'PASSED', 'FLAKY', 'TIMEOUT', 'FAILED', 'INCOMPLETE', 'REMOTE_FAILURE', 'FAILED_TO_BUILD', 'TOOL_HALTED_BEFORE_TESTING'], (s_suppkey % 11)::INT + 1) AS n FROM supplier)
SELECT s_nationkey, coalesce(n, 'UNKNOWN') AS test_status, CASE WHEN n = 'PASSED' THEN 'Ok' ELSE 'Error' END AS span_status, count(*) AS tests FROM s GROUP BY ALL""")  # fmt: skip
def test_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = status.enum_name(F.col("s_suppkey") % 11, status.TEST_STATUS)
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", name.alias("test_status"))
    return rows.groupBy("s_nationkey", "test_status", status.test_status(F.col("test_status"))["code"].alias("span_status")).agg(F.count("*").alias("tests"))


@query("""WITH r AS (SELECT event_id, epoch_us(ts) * 1000 + event_id % 1000 AS n FROM events) SELECT event_id, n AS parsed_ns, n // 1000000 AS ms, n AS sane_ns FROM r""")
def instants_in_nanos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3339 texts with nine digits keep every nanosecond."""
    frac = F.lpad((F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000 * 1000 + F.col("event_id") % 1000).cast("string"), 9, "0")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), frac, F.lit("Z"))
    rows = table(spark, sf_dir, "events").select("event_id", times.rfc3339_nanos(stamp).alias("parsed_ns"))
    sec, rest = (F.col("parsed_ns") / times.SECOND).cast("long"), F.col("parsed_ns") % times.SECOND
    return rows.select("event_id", "parsed_ns", times.duration_ms(F.expr("parsed_ns div 1000000000"), rest).alias("ms"), times.sane_start(times.to_nanos(F.expr("parsed_ns div 1000000000"), rest), F.col("parsed_ns")).alias("sane_ns"))
