"""Execution-log entries: outputs, directories and spawns put together.

Entries come decoded, one JSON object a row: an id and one of invocation, file,
directory, unresolvedSymlink, symlinkAction, runfilesTree, inputSet or spawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import SECOND, to_nanos
from ..operators.traces import stage

#: Flags that name a log, the supported ones first.
COMPACT = ("--execution_log_compact_file=", "--experimental_execution_log_compact_file=")
UNSUPPORTED = {"--execution_log_binary_file=": "--execution_log_binary_file", "--execution_log_json_file=": "--execution_log_json_file"}
_DURATIONS = ("totalTime", "parseTime", "networkTime", "fetchTime", "queueTime", "setupTime", "uploadTime", "executionWallTime", "processOutputsTime", "retryTime")


def _named(options: Column, flag: str, name: str) -> Column:
    """The name once for each option that gives the flag a value."""
    return F.transform(F.filter(options, lambda o: F.startswith(o, F.lit(flag)) & (o != flag)), lambda o: F.lit(name))


def names_log(option: Column) -> Column:
    return F.startswith(option, F.lit(COMPACT[0])) | F.startswith(option, F.lit(COMPACT[1]))


def manifest(options: DataFrame, started: DataFrame) -> DataFrame:
    """Per invocation the log's path (the first that an option names; relative
    ones under the workspace), its state, and the flags that are not supported.
    options: the typed options table."""
    listed = F.concat("cmd_line", "explicit")
    path = lambda o: F.regexp_replace(o, "^(?:" + "|".join(COMPACT) + ")", "")
    named = F.filter(listed, names_log)
    wanted = F.get(F.filter(F.transform(named, path), lambda p: p != ""), 0)
    bad = F.array_distinct(F.flatten(F.array(*[_named(listed, flag, name) for flag, name in UNSUPPORTED.items()])))
    first = F.when(wanted.isNotNull(), F.col("seq"))
    rows = options.groupBy("inv").agg(F.min_by(wanted, first).alias("log"), F.coalesce(F.min(first), F.min("seq")).alias("seq"), F.array_distinct(F.flatten(F.collect_list(bad))).alias("unsupported_flags"))
    begun = started.groupBy("inv").agg(F.min_by("workspace_dir", "seq").alias("workspace_dir"), F.min("seq").alias("started_seq"))
    joined = rows.join(begun, "inv", "left")
    full = F.when(F.startswith("log", F.lit("/")), F.col("log")).when(F.col("log").isNotNull() & F.nullif("workspace_dir", F.lit("")).isNotNull(), F.concat_ws("/", "workspace_dir", "log"))
    state = F.when(F.col("log").isNull(), F.when(F.size("unsupported_flags") > 0, "unsupported")).when(full.isNull(), "skipped").otherwise("started")
    return joined.select("inv", "log", full.alias("path"), state.alias("state"), F.array_join("unsupported_flags", ", ").alias("unsupported"), "seq", "started_seq")


def steps(read: bool) -> list[tuple[Column, str, Column]]:
    """What happens to a log, as (when, name, attributes) over the manifest: a
    relative path whose workspace is not known yet is skipped, and taken up again
    once the invocation starts; `read` adds how reading it ended, over status()
    joined to it. `when` is null where a step does not happen."""
    c = F.col
    early = ~F.startswith("log", F.lit("/")) & (c("started_seq").isNull() | (c("started_seq") > c("seq")) | c("path").isNull())
    told = lambda **x: F.map_filter(F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    out = [
        (F.when(c("unsupported") != "", c("seq")), "unsupported_format", told(flag=c("unsupported"))),
        (F.when(c("log").isNotNull() & early, c("seq")), "tailer_skipped", told(path=c("log"), reason=F.lit("workspace_directory_not_set"))),
        (F.when(c("path").isNotNull(), F.when(early, c("started_seq")).otherwise(c("seq"))), "tailer_started", told(path=c("path"))),
    ]
    end = F.when(c("path").isNotNull(), F.lit(2**62).cast("long"))  # after all else
    return out + ([(end, "tailer_finished", told(spawns_received=F.coalesce("spawns_received", F.lit(0).cast("long")), status=F.coalesce("status", F.lit("ok")), error=c("error")))] if read else [])


def status(log: DataFrame) -> DataFrame:
    """inv, spawns_received, status and error of each log: it failed where a spawn
    names an output that the log has not yet written. Spawns before the fault count."""
    get = F.try_variant_get("v", "$.spawn.outputs", "array<struct<outputId bigint, invalidOutputPath string>>")
    own = log.filter("kind = 'spawn'").select("inv", "seq", F.explode_outer(get).alias("o")).select("inv", "seq", F.col("o.outputId").alias("id"))
    known = log.filter("id <> 0 and kind <> 'spawn'").groupBy("inv", "id").agg(F.min("seq").alias("_since"))
    bad = F.col("id").isNotNull() & (F.col("_since").isNull() | (F.col("_since") > F.col("seq")))
    by_spawn = own.join(known, ["inv", "id"], "left").groupBy("inv", "seq").agg(F.bool_or(bad).alias("bad"))
    fault = by_spawn.groupBy("inv").agg(F.min(F.when(F.col("bad"), F.col("seq"))).alias("_fault"))
    counted = by_spawn.join(fault, "inv").groupBy("inv", "_fault").agg(F.count_if(F.col("_fault").isNull() | (F.col("seq") < F.col("_fault"))).alias("spawns_received"))
    failed = F.col("_fault").isNotNull()
    return counted.select("inv", "spawns_received", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "output id without entry").alias("error"))


def _time(value: Column) -> Column:
    """Nanoseconds of a VARIANT: seconds as a text, or seconds and nanos. Both are
    read at once, since a text holds no fields and looking for each takes its time."""
    get = lambda of: F.try_variant_get(value, "$", of)
    both = get("struct<seconds bigint, nanos bigint>")
    dotted = F.regexp_extract(get("string"), r"^([0-9]+(?:\.[0-9]+)?)s$", 1).try_cast("decimal(20,9)") * SECOND
    return F.when(value.isNotNull(), F.coalesce(to_nanos(both["seconds"], both["nanos"]), both["nanos"], dotted.cast("long")))


def entries(lines: DataFrame) -> DataFrame:
    """lines: inv, seq, raw. Adds v, id and kind, the first key but for the id.

    What comes from parsing is generated as a row of one: filters on it then read
    the result, where those on a plain column would parse once more each. Where an
    entry begins with its kind, or its id and then its kind, as they are written, the
    kind is read off; only others are parsed once more for it."""
    begins = F.nullif(F.regexp_extract("raw", r'^\s*+\{\s*+(?:"id"\s*+:\s*+(?:[0-9]++|"[0-9]++")\s*+,\s*+)?+"(?!id")([A-Za-z0-9_]++)"\s*+:', 1), F.lit(""))
    keys = F.filter(F.json_object_keys("raw"), lambda k: k != "id")
    kind = F.coalesce(begins, F.get(keys, 0))
    parsed = lines.select("*", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("v"), kind.alias("kind"))))).filter("v is not null")
    return parsed.select(*lines.columns, "v", F.coalesce(F.try_variant_get("v", "$.id", "bigint"), F.lit(0).cast("long")).alias("id"), "kind")


def stands_for() -> tuple[Column, Column]:
    """What an entry (v, kind) stands for as an output: its files, and the path it is
    listed by. Directories give their files under their path, symlinks themselves;
    runfiles trees give nothing."""
    get = lambda p, of="string": F.try_variant_get("v", p, of)
    file = "struct<path string, digest struct<hash string, sizeBytes bigint>>"
    one = F.array(F.struct(get("$.file.path").alias("path"), get("$.file.digest.hash").alias("hash"), get("$.file.digest.sizeBytes", "bigint").alias("size")))
    inside = F.transform(F.coalesce(get("$.directory.files", f"array<{file}>"), F.array().cast(f"array<{file}>")), lambda f: F.struct(F.concat_ws("/", get("$.directory.path"), f["path"]).alias("path"), f["digest"]["hash"].alias("hash"), f["digest"]["sizeBytes"].alias("size")))
    link = F.array(F.struct(get("$.unresolvedSymlink.path").alias("path"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("bigint").alias("size")))
    files = F.when(F.col("kind") == "file", one).when(F.col("kind") == "directory", inside).when(F.col("kind") == "unresolvedSymlink", link).otherwise(F.array().cast(FILES))
    return files, F.coalesce(get("$.file.path"), get("$.directory.path"), get("$.unresolvedSymlink.path"))


def outputs(log: DataFrame) -> DataFrame:
    """inv, id, since, until, kind, files, path: what each output id stands for from
    the entry that writes it to the one that writes it anew (until null: to the
    end). Staged, so that the join with the uses can split an id that many use."""
    again, (files, path) = Window.partitionBy("inv", "id").orderBy("seq"), stands_for()
    written = log.filter("id <> 0 and kind <> 'spawn'")
    return stage(written.select("inv", "id", F.col("seq").alias("since"), F.lead("seq").over(again).alias("until"), "kind", files.alias("files"), path.alias("path")))


#: What a file of an output is.
FILES = "array<struct<path:string,hash:string,size:bigint>>"


def spawn_fields(log: DataFrame, *more: str) -> DataFrame:
    """inv, seq and the fields of every spawn entry; outs are its outputs by id. Every
    field is taken in the first projection, so that a scan of a staged log reads it
    from its own column and never builds an entry again. Times are then read by one
    expression over all, so that the code of a row stays short enough to be compiled."""
    get = lambda p, of="string": F.try_variant_get("v", p, of)
    names = ("start_time_ns", *_DURATIONS)
    fields = log.filter("kind = 'spawn'").select(
        "inv", "seq", get("$.spawn.targetLabel").alias("label"), get("$.spawn.mnemonic").alias("mnemonic"), F.coalesce(get("$.spawn.args", "array<string>"), F.array().cast("array<string>")).alias("args"),
        get("$.spawn.runner").alias("runner"), F.coalesce(get("$.spawn.cacheHit", "boolean"), F.lit(False)).alias("cache_hit"), F.coalesce(get("$.spawn.remoteCacheable", "boolean"), F.lit(False)).alias("remote_cacheable"),
        get("$.spawn.exitCode", "int").alias("exit_code"), get("$.spawn.status").alias("status"), get("$.spawn.digest.hash").alias("digest"),
        F.transform(F.array(*[get(f"$.spawn.metrics.{d}", "variant") for d in ("startTime", *_DURATIONS)]), _time).alias("_times"),
        F.coalesce(get("$.spawn.outputs", "array<struct<outputId bigint, invalidOutputPath string>>"), F.array().cast("array<struct<outputId:bigint,invalidOutputPath:string>>")).alias("outs"), *more,
    )
    before = fields.columns[: fields.columns.index("_times")]
    return fields.select(*before, *[F.col("_times")[i].alias(n) for i, n in enumerate(names)], "outs", *more)


def finished(fields: DataFrame) -> DataFrame:
    """Spawns of spawn_fields() that have listed, actual and hash_function beside."""
    whole = fields.drop("outs").withColumns({"listed": F.coalesce("listed", F.array().cast("array<string>")), "actual": F.coalesce("actual", F.array().cast(FILES))})
    return whole.withColumn("end_time_ns", F.col("start_time_ns") + F.coalesce("totalTime", F.lit(0).cast("long")))


def hash_functions(log: DataFrame) -> DataFrame:
    name = F.try_variant_get("v", "$.invocation.hashFunctionName", "string")
    return log.filter("kind = 'invocation'").groupBy("inv").agg(F.max(name).alias("hash_function"))


def spawns(log: DataFrame, strict: bool = True) -> DataFrame:
    """Spawns with listed and actual outputs: an id stands for what was written last
    before the spawn. An output id that its log has no earlier entry of makes the
    log corrupt: strict stops the job, else its spawns are left out.

    The parsed log is staged once, spawns in a folder of their own: uses, fields,
    outputs and hash functions read it there, and nothing is parsed again."""
    log = stage(log.select("inv", "seq", "id", "kind", "v", (F.col("kind") == "spawn").alias("ran")), by="ran")
    base = spawn_fields(log.filter("ran"))
    each = base.select("inv", "seq", F.posexplode("outs").alias("pos", "o")).withColumn("out_id", F.col("o.outputId"))
    known = outputs(log.filter("not ran")).select(F.col("inv").alias("_inv"), F.col("id").alias("_id"), "since", "until", "kind", "files", "path")
    at = (F.col("inv") == F.col("_inv")) & (F.col("out_id") == F.col("_id")) & (F.col("since") <= F.col("seq")) & (F.col("until").isNull() | (F.col("until") > F.col("seq")))
    found = each.join(known, at, "left").select("inv", "seq", "pos", "o", "kind", "files", "path")
    lost = F.col("o.outputId").isNotNull() & F.col("kind").isNull()
    if strict:
        found = found.withColumn("path", F.when(lost, F.raise_error(F.lit("output id without entry")).cast("string")).otherwise(F.col("path")))
    listed = F.array_sort(F.collect_set(F.coalesce("o.invalidOutputPath", "path")))
    actual = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "files"))), lambda x: F.coalesce(x["files"], F.array().cast(FILES))))
    grouped = found.groupBy("inv", "seq").agg(listed.alias("listed"), actual.alias("actual"), F.bool_or(lost).alias("corrupt"))
    joined = base.join(grouped, ["inv", "seq"], "left").join(hash_functions(log.filter("not ran")), "inv", "left")
    if not strict:
        bad = grouped.groupBy("inv").agg(F.bool_or("corrupt").alias("bad")).filter("bad").select("inv")
        joined = joined.join(bad, "inv", "left_anti")
    return finished(joined.drop("corrupt"))
