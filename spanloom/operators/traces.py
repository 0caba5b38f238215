"""Joins and roll-ups that build a trace: lifecycles, parents, spawns, closures.

Everything is keyed, so scale comes from rows and invocations; sides whose size
is not bounded by the schema are joined without hints and left to AQE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..functions.times import clamp
from .ordered import numbered
from .staging import passing, stage


def lifecycle(configured: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of what was configured with what completed; state tells which
    side is missing: done, open (never completed) or unknown (never configured)."""
    left, right = configured.withColumn("_c", F.lit(True)), completed.withColumn("_d", F.lit(True))
    state = F.when(F.col("_c") & F.col("_d"), "done").when(F.col("_c"), "open").otherwise("unknown")
    return left.join(right, keys, "full").withColumn("state", state).drop("_c", "_d")


def parents(children: DataFrame, targets: DataFrame, inv: list[str], label: str, target_label: str, span: str) -> DataFrame:
    """children with parent: the target of the same label, else one whose label
    is equal in normal form, else null and synthetic."""
    exact = targets.groupBy(*inv, target_label).agg(F.min(span).alias("_exact")).withColumnRenamed(target_label, "_label")
    loose = targets.groupBy(*inv, normalize_label(F.col(target_label)).alias("_norm")).agg(F.min_by(span, target_label).alias("_loose"))
    rows = children.withColumn("_label", F.col(label)).withColumn("_norm", normalize_label(F.col(label)))
    joined = rows.join(exact, [*inv, "_label"], "left").join(loose, [*inv, "_norm"], "left")
    return joined.withColumn("parent", F.coalesce("_exact", "_loose")).withColumn("synthetic", F.col("parent").isNull()).drop("_label", "_norm", "_exact", "_loose")


def clamp_columns(df: DataFrame, start: str, end: str, lower: str, upper: str) -> DataFrame:
    """df with start and end fitted into the bounds (all BIGINT)."""
    a, b = clamp(F.col(start), F.col(end), F.col(lower), F.col(upper))
    return df.withColumns({start: a, end: b})


def match_ranked(spawns: DataFrame, actions: DataFrame, inv: list[str], spawn_key: list[str], candidates: str, action_on: list[str], output: str, action_id: str) -> DataFrame:
    """The action of each spawn: of its candidate outputs, best first, the first
    that an action has. Spawns that match none are left out (see orphans)."""
    tries = spawns.select(*dict.fromkeys([*inv, *spawn_key, *action_on]), F.posexplode(candidates).alias("rank", output))
    hits = tries.join(actions.select(*dict.fromkeys([*inv, *action_on, output, action_id])), [*dict.fromkeys([*inv, *action_on]), output])
    return hits.groupBy(*dict.fromkeys([*inv, *spawn_key])).agg(F.min_by(F.struct(action_id, "rank"), F.struct("rank", action_id)).alias("_m")).select(*dict.fromkeys([*inv, *spawn_key]), f"_m.{action_id}", "_m.rank")


def orphans(spawns: DataFrame, matched: DataFrame, spawn_key: list[str], group: list[str], start: str, end: str, label: str, seq: str) -> DataFrame:
    """Spawns without an action, one row a group: bounds, count, first label."""
    alone = spawns.join(matched.select(*spawn_key), spawn_key, "left_anti")
    return alone.groupBy(*group).agg(F.min(start).alias("start_ns"), F.max(end).alias("end_ns"), F.count("*").alias("spawns"), F.min_by(label, seq).alias("label"))


def spawn_summary(actions: DataFrame, spawns: DataFrame, keys: list[str]) -> DataFrame:
    """actions with spawn_count and whether none was seen."""
    counts = spawns.groupBy(*keys).agg(F.count("*").alias("_n"))
    return actions.join(counts, keys, "left").withColumn("spawn_count", F.coalesce("_n", F.lit(0).cast("long"))).withColumn("spawn_missing", F.col("_n").isNull()).drop("_n")


def first_spawn(spawns: DataFrame, keys: list[str], order: list[Column], *attributes: str) -> DataFrame:
    """Count and the first spawn's attributes for each action."""
    got = spawns.groupBy(*keys).agg(F.count("*").alias("spawn_count"), F.min_by(F.struct(*attributes), F.struct(*order)).alias("_s"))
    return got.select(*keys, "spawn_count", "_s.*")


def named(rows: DataFrame, names: DataFrame, keys: list[str], key: str, name: str, out: str) -> DataFrame:
    """rows with `out`: the name of their key, else the key itself. names: the keys,
    the key and its name, a row a key."""
    found = names.select(*keys, key, F.col(name).alias("_name"))
    return rows.join(found, [*keys, key], "left").withColumn(out, F.coalesce("_name", F.col(key).cast("string"))).drop("_name")


def child_bounds(children: DataFrame, keys: list[str], start: str, end: str, seq: Column) -> DataFrame:
    """What a parent known by its children alone takes from them: the start of the
    first that has one (of equal seq the earliest), the last end, and how many there are."""
    first = F.when(F.col(start).isNotNull(), F.struct(seq.alias("seq"), F.col(start).alias("start")))
    return children.groupBy(*keys).agg(F.min_by(start, first).alias("child_start"), F.max(end).alias("child_end"), F.count("*").alias("children"))


def groups(children: DataFrame, keys: list[str], group: str, start: str) -> DataFrame:
    """One row for each group that has a child, and its first start."""
    return children.groupBy(*keys, group).agg(F.min(start).alias("first"))


def first_and_total(rows: DataFrame, keys: list[str], item: str, order: list[str], shown: int) -> DataFrame:
    """keys, total and shown: how many rows a key has and the first few items. The
    ranking is limited before the shuffle and no list is longer than `shown`."""
    place = Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= shown)
    lists = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(item).alias("_item")))), lambda x: x["_item"]).alias("shown"))
    return rows.groupBy(*keys).agg(F.count("*").alias("total")).join(lists, keys)


def closure(edges: DataFrame, roots: DataFrame, parent: str, child: str, root: str, rounds: int | None = None) -> DataFrame:
    """(root, node, depth) for all nodes that a root reaches, itself included (depth
    0), cycles and diamonds once, at the depth of the first visit. Each round joins
    the frontier alone; rounds are staged, so the plan stays short and survives lost
    executors. It ends when a round adds nothing; `rounds`, if given, stops the job
    beyond that depth. Roots that are given several times are followed once."""
    step = edges.select(F.col(parent).alias("node"), F.col(child).alias("_next")).distinct()
    frontier = stage(roots.select(F.col(root).alias("root"), F.col(root).alias("node")).distinct().withColumn("depth", F.lit(0)))
    done, depth = frontier, 0
    while rounds is None or depth < rounds:
        depth += 1
        reached = frontier.join(step, "node").select("root", F.col("_next").alias("node")).distinct()
        frontier = stage(reached.join(done, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return done
        done = done.unionByName(frontier)
    raise RuntimeError("closure deeper than the allowed rounds")


def trace_check(spans: DataFrame, trace: str, span_id: str, parent: str, name: str, tool: str) -> DataFrame:
    """Span count, whether a root named by the tool is there, and dangling parents.
    Each span is a definition of its id and a reference to its parent's; one
    grouping by id tells which references meet none, a roll-up counts them."""
    root = F.col(parent).isNull() & F.startswith(F.col(name), F.lit(tool))
    none = F.lit(None).cast("string")
    marks = F.array(
        F.struct(F.col(span_id).cast("string").alias("id"), F.lit(1).alias("defined"), F.lit(0).alias("used"), root.alias("root")),
        F.struct(F.when(F.col(parent).isNotNull(), F.col(parent).cast("string")).otherwise(none).alias("id"), F.lit(0).alias("defined"), F.lit(1).alias("used"), F.lit(False).alias("root")),
    )
    each = spans.select(F.col(trace), F.explode(marks).alias("m")).select(trace, "m.*").filter("defined = 1 or id is not null")
    by_id = each.groupBy(trace, "id").agg(F.sum("defined").alias("spans"), F.sum("used").alias("used"), F.bool_or("root").alias("root"))
    return by_id.groupBy(trace).agg(F.sum("spans").alias("span_count"), F.bool_or("root").alias("has_root"), F.coalesce(F.sum(F.when(F.col("spans") == 0, F.col("used"))), F.lit(0).cast("long")).alias("dangling"))


def depths(links: DataFrame, most: Callable[[], int]) -> DataFrame:
    """n and depth, 0 for a root, of links (n, up: the number of the span over it,
    null for a root) that a root is over; what hangs in a cycle or below a number
    that is not there is left out. Pointer doubling: each round joins every open span
    to the one that its pointer shows, which doubles the distance, so a tree of depth
    d takes log2(d) rounds. A cycle stays open, and ends when the distance exceeds
    the largest trace, which `most` counts if it comes to that."""
    c = F.col
    now = links.select("n", c("up").alias("at"), F.lit(1).alias("steps"))
    done, open_ = now.filter("at is null"), now.filter("at is not null")
    reach, bound = 1, None
    while not open_.isEmpty():
        if bound is None and reach >= 4:  # deeper than most: how far can it go
            bound = most()
        if bound is not None and reach > bound:
            break
        known = done.unionByName(open_).select(c("n").alias("at"), c("at").alias("_at"), c("steps").alias("_steps"))
        met = open_.join(known, "at")  # who points at nothing leaves
        moved = stage(met.select("n", c("_at").alias("at"), (c("steps") + c("_steps")).alias("steps")))
        done, open_ = done.unionByName(moved.filter("at is null")), moved.filter("at is not null")
        reach *= 2
    return done.select("n", (c("steps") - 1).alias("depth"))


def tree_order(spans: DataFrame, trace: str, span_id: str, parent: str, start: str, end: str) -> DataFrame:
    """spans with depth (0 for a root) and place: their number in the trace, parents
    before children, siblings by start (those without one by their end), then id.
    Trees may have any depth. A span that no root is over, be its parent missing or
    in a cycle, has no depth and comes after all others.

    Spans are staged once, whole (hand over what is wanted of them), numbered by
    trace, parent, start and id over ranges, which ranks siblings. Ids are long and
    meet once, when spans take the number of their parent. All else works on numbers:
    depths by pointer doubling, then each span's path (the numbers of its ancestors,
    eight bytes each, which sort as they stand) in the same way, as many rounds as the
    deepest tree needs. Spans are placed by trace and path over ranges, and take depth
    and place by number. Rows of one trace and id are one node of the tree, as the one
    of the lowest number tells it, and stand one behind the other; rows without a
    trace or id have neither depth nor place. What was staged on the way goes."""
    c = F.col
    at = F.coalesce(F.col(start), F.col(end), F.lit(0).cast("long"))
    name = F.encode(F.col(span_id).cast("string"), "utf-8")
    parts, order = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c(trace), c(parent), at, name]
    eight = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    with passing(spans.sparkSession) as keep:
        rows = keep(spans.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
        known = rows.select(c("_n").alias("n"), c(trace).alias("trace"), c(span_id).alias("id"), c(parent).alias("up"), at.alias("at"), name.alias("name")).filter("trace is not null and id is not null")
        over = known.groupBy(c("trace").alias("_t"), c("id").alias("_i")).agg(F.min("n").alias("_n"), F.min_by("at", "n").alias("_at"), F.count("*").alias("_rows"))
        again = stage(over.filter("_rows > 1").drop("_rows"))  # few, as a rule
        each = known.join(again, (c("trace") == c("_t")) & (c("id") == c("_i")), "left").select("n", "trace", "up", "at", "name", F.coalesce("_n", "n").alias("node"), F.coalesce("_at", "at").alias("node_at"))
        with passing(spans.sparkSession) as keep_paths:
            met = each.filter("n = node").select("n", "trace", "up").join(over.select("_t", "_i", c("_n").alias("_up")), (c("trace") == c("_t")) & (c("up") == c("_i")), "left")
            links = stage(met.filter("up is null or _up is not null").select("n", c("_up").alias("up")))
            deep = stage(depths(links, lambda: known.groupBy("trace").count().agg(F.max("count")).first()[0] or 0))
            deepest = deep.agg(F.max("depth")).first()[0] or 0
            paths, reach = links.join(deep, "n").select("n", "up", "depth", eight(c("n")).alias("path")), 1
            while reach <= deepest:
                ahead = paths.select(c("n").alias("up"), c("up").alias("_up"), c("path").alias("_path"))
                paths = stage(paths.join(ahead, "up", "left").select("n", c("_up").alias("up"), "depth", F.coalesce(F.concat("_path", "path"), "path").alias("path")))
                reach *= 2
            paths = keep_paths(paths.select(c("n").alias("node"), "depth", "path"))
        lone = F.concat(eight(c("node_at").bitwiseXOR(F.lit(-(2**63)).cast("long"))), "name")
        told = each.join(paths, "node", "left").select("n", "trace", "depth", c("depth").isNull().alias("_lost"), F.coalesce("path", lone).alias("path"), "at")
        placed = numbered(told, "trace", [c("_lost"), c("path"), c("at"), c("n")], "place", ["trace", "n", "depth"], keep)
    return rows.join(placed.select(c("n").alias("_m"), "depth", c("place").cast("int").alias("place")), c("_n") == c("_m"), "left").drop("_n", "_m")
