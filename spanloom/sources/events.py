"""Build events: NDJSON and envelope scans, classification, quarantine, caps.

The event table has file, seq, raw (the event's JSON) and, once classified, v
(VARIANT), event_type, last_message and event_time_ns. seq stands for arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import rfc3339_nanos
from ..operators import traces

#: Kinds of events that carry nothing for a trace.
IGNORED = ("structuredCommandLine", "convenienceSymlinksIdentified", "workspace", "workspaceConfig", "testProgress", "execRequest", "unknown")

#: Characters of one string that the JSON parser reads.
STRING_LIMIT = 20_000_000


def scan_ndjson(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine). Blank lines are skipped. FAILFAST stops at the first
    bad line; PERMISSIVE hands bad lines on in the quarantine.

    seq rises with the lines of a file and needs no sort: the start of the line's
    split plus its number in the task. A task reads no more bytes than the splits
    of a file are apart and a line has one byte at least, so numbers of one split
    stay below those of the next."""
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("seq"), F.col("value").alias("raw"))
    return classify(lines.filter(F.trim("raw") != ""), mode)


def unwrap_envelope(envelopes: DataFrame, column: str = "value") -> DataFrame:
    """file, seq, raw and event_time_ns of enveloped build events; other
    envelopes (console output, finished components) go."""
    get = lambda p: F.get_json_object(column, p)
    kind = F.coalesce(get("$.orderedBuildEvent.event.bazelEvent.typeUrl"), get("$.orderedBuildEvent.event.bazelEvent['@type']"), get("$.event.bazelEvent.typeUrl"), get("$.event.bazelEvent['@type']"))
    body = F.coalesce(get("$.orderedBuildEvent.event.bazelEvent"), get("$.event.bazelEvent"))
    when = F.coalesce(get("$.orderedBuildEvent.event.eventTime"), get("$.event.eventTime"))
    seq = F.coalesce(get("$.orderedBuildEvent.sequenceNumber"), get("$.sequenceNumber")).try_cast("bigint")
    stream = F.coalesce(get("$.orderedBuildEvent.streamId.invocationId"), get("$.streamId.invocationId"))
    return envelopes.filter(F.contains(kind, F.lit("BuildEvent")) | F.contains(kind, F.lit("build_event_stream"))).select(stream.alias("file"), seq.alias("seq"), body.alias("raw"), rfc3339_nanos(when).alias("event_time_ns"))


def classify(events: DataFrame, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): the type is the first key of id; an event that is no
    JSON or has no id is quarantined, or stops the job in FAILFAST mode. Spark's
    parser reads strings of up to STRING_LIMIT characters; a larger event that it
    does not read is quarantined with a reason that says so.

    What comes from parsing is generated as a row of one: filters on it then read
    the result, where those on a plain column would parse once more each. Where an
    event begins with its id, as they are written, its kind is read off; only others
    are parsed once more for it."""
    begins = F.nullif(F.regexp_extract("raw", r'^\s*+\{\s*+"id"\s*+:\s*+\{\s*+"([A-Za-z0-9_]++)"\s*+:', 1), F.lit(""))
    kind = F.coalesce(begins, F.get(F.json_object_keys(F.get_json_object("raw", "$.id")), 0))
    parsed = events.select("*", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("v"), kind.alias("event_type")))))
    reason = F.when(F.col("v").isNull() & (F.length("raw") > STRING_LIMIT), "not JSON, or above the parser's limits").when(F.col("v").isNull(), "not JSON").when(F.col("event_type").isNull(), "missing event id")
    parsed = parsed.withColumn("last_message", F.coalesce(F.try_variant_get("v", "$.lastMessage", "boolean"), F.try_variant_get("v", "$.last_message", "boolean"), F.lit(False)))
    if "event_time_ns" not in events.columns:
        parsed = parsed.withColumn("event_time_ns", F.lit(None).cast("long"))
    if mode == "FAILFAST":
        stop = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("bad event: "), reason)).cast("string")).otherwise(F.col("event_type"))
        return parsed.withColumn("event_type", stop), parsed.filter("false").withColumn("reason", F.lit("")).drop("v")
    marked = parsed.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").drop("v")


def invocations(events: DataFrame) -> DataFrame:
    """Events of one stream up to its last message, numbered by invocation: each
    `started` opens the next; inv names stream and number. A stream that starts
    once is one invocation, early events included.

    Only starts and last messages are gathered, a row a stream, and joined back:
    payloads are never sorted, and a stream that holds a large part of all rows
    is split by the skew join."""
    begins, ends = F.when(F.col("event_type") == "started", F.col("seq")), F.when(F.col("last_message"), F.col("seq"))
    # a text without these words (or an escape that may hide one) is no mark, and need not be parsed to tell
    told = [F.contains("raw", F.lit(w)) for w in ("started", "lastMessage", "last_message", "\\u")] if "raw" in events.columns else [F.lit(True)]
    likely = events.filter(reduce(Column.__or__, told))
    marks = likely.filter("event_type = 'started' or last_message").groupBy(F.col("file").alias("_file")).agg(F.array_sort(F.collect_list(begins)).alias("_begins"), F.min(ends).alias("_end"))
    joined = events.join(marks, F.col("file").eqNullSafe(F.col("_file")), "left").filter("_end is null or seq <= _end")
    number = F.greatest(F.size(F.filter("_begins", lambda b: b <= F.col("seq"))), F.lit(1))
    return joined.withColumn("inv", F.concat_ws("#", "file", F.coalesce(number, F.lit(1)).cast("string"))).drop("_file", "_begins", "_end")


def parsed(events: DataFrame) -> DataFrame:
    """Classified events written once, a folder a kind, for those who read few kinds:
    invocations() of it looks at starts and last messages without any text being
    made or parsed again. All kinds are kept, since any may be the last message."""
    return traces.stage(events.drop("raw"), by="event_type")


def bronze(events: DataFrame) -> DataFrame:
    """The events written once, a folder a kind: each typed table then reads its
    own kind and nothing is split or parsed again."""
    return traces.stage(events.drop("raw").filter(~F.col("event_type").isin(*IGNORED)), by="event_type")


def quality(events: DataFrame) -> DataFrame:
    """Events by type, and whether they are ignored."""
    return events.groupBy("event_type", F.col("event_type").isin(*IGNORED).alias("ignored")).agg(F.count("*").alias("n"))


def enforce_caps(entries: DataFrame, keys: list[str], raw: str, order: list[str], entry_bytes: int = 64 << 20, total_bytes: int = 2 << 30, on_violation: str = "drop_log") -> DataFrame:
    """Logs with an entry or a total over its cap are dropped, or stop the job."""
    over = (F.max(F.octet_length(raw)) > entry_bytes) | (F.sum(F.octet_length(raw).cast("long")) > total_bytes)
    bad = entries.groupBy(*keys).agg(over.alias("over")).filter("over").select(*keys)
    if on_violation == "fail":
        bad = bad.withColumn("_stop", F.raise_error(F.lit("log over its size cap")).cast("string"))
    return entries.join(bad, keys, "left_anti") if on_violation != "fail" else entries.join(bad, keys, "left").filter("_stop is null").drop("_stop")


def file_uri(file: Column) -> Column:
    """The URI of a file oneof in a VARIANT, else null."""
    return F.try_variant_get(file, "$.uri", "string")


def workspace_names(files: DataFrame) -> DataFrame:
    """inv, repository: the name in the module or workspace file, MODULE.bazel
    first. files: inv, file_name, content, directory."""
    rank = F.array_position(F.array(*map(F.lit, ("MODULE.bazel", "WORKSPACE.bazel", "WORKSPACE"))), F.col("file_name"))
    block = F.regexp_extract("content", r"(?m)^\s*(?:module|workspace)\s*\(((?:[^()]|\([^()]*\))*)\)", 1)
    name = F.nullif(F.regexp_extract(block, r"\bname\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    found = files.filter(rank > 0).select("inv", F.col("directory"), name.alias("name"), rank.alias("rank"))
    base = F.element_at(F.split(F.regexp_replace("directory", "/+$", ""), "/"), -1)
    return found.groupBy("inv").agg(F.coalesce(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("rank"))), F.min(base)).alias("repository"))
