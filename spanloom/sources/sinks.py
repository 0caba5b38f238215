"""Sinks: Parquet tables, OTLP-shaped JSON, summary lines, idempotent batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import to_timestamp
from ..operators import ordered, staging


def resource_columns(df: DataFrame, service: str = "bazel", sdk: str = "spanloom", version: str = "0.1") -> DataFrame:
    return df.withColumns({"service_name": F.lit(service), "sdk_name": F.lit(sdk), "sdk_version": F.lit(version)})


def write_spans(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Spans by day of their start; spans without a start go by their end. Days are
    brought together before, so that not every task writes a file for every day; a
    day with many spans is split again (rebalancing)."""
    day = F.to_date(to_timestamp(F.coalesce("start_ns", "end_ns", F.lit(0).cast("long"))))
    resource_columns(spans).withColumn("build_date", day).hint("rebalance", "build_date").write.mode(mode).partitionBy("build_date").parquet(path)


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    resource_columns(logs).write.mode(mode).parquet(path)


def _attributes(attrs: Column) -> Column:
    return F.transform(F.map_entries(attrs), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


#: Spans of a trace that one task sorts; larger traces are sorted over ranges.
TRACE_LIMIT = 1_000_000


def _places(spans: DataFrame, limit: int) -> DataFrame:
    """spans with _n, their number in their trace by start and id. Spans are made
    once; those of a trace then meet in one shuffle, which serves what groups by
    trace after it. Traces above the limit, at most one in `limit` spans, are told
    by a count before and numbered by a sort over ranges."""
    spans, order = staging.stage(spans), [F.col("start_ns"), F.col("span_id")]
    large = staging.stage(spans.groupBy("trace_id").agg(F.count("*").alias("_of")).filter(F.col("_of") > limit).select(F.col("trace_id").alias("_large")))
    same, some = F.col("trace_id").eqNullSafe(F.col("_large")), not large.isEmpty()
    rest = spans.join(F.broadcast(large), same, "left_anti") if some else spans
    small = rest.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy(*order)).cast("long"))
    if not some:
        return small
    return small.unionByName(ordered.numbered(spans.join(F.broadcast(large), same, "left_semi"), "trace_id", order, "_n"))


def otlp_json(spans: DataFrame, batch: int = 512, service: str = "bazel", limit: int = TRACE_LIMIT) -> DataFrame:
    """One JSON document (resource, scope, spans) per trace and batch of spans.
    Batches are numbered within a trace; a document never holds more than `batch`
    spans, whatever the size of the trace, and no task sorts more than `limit` spans
    of one trace."""
    numbered = _places(spans, limit).withColumn("_batch", F.floor((F.col("_n") - 1) / batch))
    code = F.when(F.col("status_code") == "Ok", 1).when(F.col("status_code") == "Error", 2).otherwise(0)
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name",
        F.when(F.col("kind") == "fetch", 3).otherwise(1).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        _attributes(F.col("attrs")).alias("attributes"), F.struct(code.alias("code"), F.col("status_desc").alias("message")).alias("status"),
    )
    grouped = numbered.groupBy("trace_id", "_batch").agg(F.array_sort(F.collect_list(F.struct("start_ns", "span_id", span.alias("s")))).alias("rows"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit("spanloom").alias("name")).alias("scope"), F.transform("rows", lambda r: r["s"]).alias("spans"))
    document = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    return grouped.select("trace_id", F.col("_batch").cast("long").alias("batch"), F.to_json(document).alias("value"))


def write_otlp_json(spans: DataFrame, path: str, batch: int = 512, mode: str = "append") -> None:
    otlp_json(spans, batch).select("value").write.mode(mode).text(path)


def idempotent_sink(path: str, keys: tuple[str, ...] = ("trace_id", "span_id"), query: str | None = None):
    """For foreachBatch: each micro-batch writes its own folder, so a batch that is
    run again replaces itself; duplicates within a batch go, and so do rows whose
    keys an earlier batch has written.

    The keys that were written stand beside, in `_keys` by day of the span (readers
    pass over that folder). A span that comes again has its day, so a batch lists
    and reads the keys of its own days alone, however many batches came before.
    Folders are `batch=<number>` for the first query that writes to the path;
    another one, such as a query with a new checkpoint, which counts from 0 again,
    writes `batch=<query>-<number>` and overwrites nothing. query: by default the
    id of the streaming query, which its checkpoint keeps."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sc = spark.sparkContext
        own = query or sc.getLocalProperty("sql.streaming.queryId") or "batch"
        at = lambda *parts: sc._jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
        files = at().getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(at("_keys", "first")):
            files.mkdirs(at("_keys", "first", own))  # the first query on this path
        first = files.exists(at("_keys", "first", own))
        name = str(number) if first else f"{own}-{number}"
        day = F.to_date(to_timestamp(F.coalesce("start_ns", "end_ns", F.lit(0).cast("long")))).cast("string")
        fresh = batch.dropDuplicates(list(keys)).withColumn("_day", day)
        days = [r[0] for r in fresh.select("_day").distinct().collect()]  # as many as the batch has days
        held = [f"{path}/_keys/day={d}" for d in days if files.exists(at("_keys", f"day={d}"))]
        if held:
            earlier = spark.read.option("basePath", f"{path}/_keys").schema(f"{fresh.select(*keys).schema.toDDL()}, day string, writer string").parquet(*held)
            other = earlier.filter(F.col("writer") != f"{own} {number}").select(F.col("day").alias("_day"), *keys)
            fresh = fresh.join(other, ["_day", *keys], "left_anti")
        fresh.drop("_day").write.mode("overwrite").parquet(f"{path}/batch={name}")
        written = spark.read.schema(batch.schema).parquet(f"{path}/batch={name}")
        keyed = written.select(*keys, day.alias("day"), F.lit(f"{own} {number}").alias("writer"))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "writer").parquet(f"{path}/_keys")

    return write
