"""Live traces equal batch traces; progress flows at once; sinks are idempotent."""

import datetime as dt
import json

from spanloom.operators import assemble
from spanloom.sources import events as source
from spanloom.sources import sinks
from spanloom.streaming import live
from tests.test_traces import event, scenario

T0 = dt.datetime(2024, 1, 1)


def feed(spark, path, rows, name):
    spark.createDataFrame(rows, live.EVENT).coalesce(1).write.mode("append").parquet(path)


def test_live_equals_batch(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    one = [("one", i, T0 + dt.timedelta(seconds=i), json.dumps(e)) for i, e in enumerate(scenario())]
    two = [("two", i, T0 + dt.timedelta(seconds=i), json.dumps(e)) for i, e in enumerate([event("started", started={"uuid": "q"}), event("fetch", {"url": "u"}, fetch={"success": True})])]
    feed(spark, src, one[:9] + two, "a")
    query = live.released(live.deduplicated(live.read_events(spark, src)), idle_ms=60_000).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(live.traces_to(sinks.idempotent_sink(out))).start()
    try:
        query.processAllAvailable()
        feed(spark, src, one[9:] + one[:3], "b")
        query.processAllAvailable()
        feed(spark, src, [("beat", 0, T0 + dt.timedelta(hours=2), '{"id": {"progress": {}}}')], "c")
        query.processAllAvailable()
        feed(spark, src, [("beat", 1, T0 + dt.timedelta(hours=2, seconds=1), '{"id": {"progress": {}}}')], "d")
        query.processAllAvailable()
    finally:
        query.stop()
    live_rows = spark.read.parquet(out).drop("batch")
    good, _ = source.classify(spark.createDataFrame([r[:2] + r[3:] for r in one + two], "file string, seq long, raw string"))
    want = assemble.build(source.invocations(good))
    key = lambda df: sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.select(*want.columns).collect())
    assert key(live_rows) == key(want)


def test_progress_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    feed(spark, src, [("f", i, T0, json.dumps(e)) for i, e in enumerate(scenario())], "a")
    query = live.progress(live.read_events(spark, src)).writeStream.format("memory").queryName("progress_rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [r.stdout for r in spark.table("progress_rows").orderBy("seq").collect()] == ["hi --define=TOKEN=***", "after the end"]


def test_documents_of_large_and_small_traces(spark):
    """Traces above the limit are sorted over ranges, others meet in one shuffle."""
    from pyspark.sql import functions as F

    rows = [(t, f"{i:016x}", i % 7) for t, n in (("a", 23), ("b", 4), (None, 9), ("c", 1)) for i in range(n)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, start_ns long").select("*", F.lit(None).cast("string").alias("parent_span_id"), F.lit("n").alias("name"), F.lit("action").alias("kind"), F.lit(9).cast("long").alias("end_ns"), F.lit("Ok").alias("status_code"), F.lit(None).cast("string").alias("status_desc"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    for limit in (8, 100):
        got = {(r.trace_id, r.batch): [s["spanId"] for s in json.loads(r.value)["resourceSpans"][0]["scopeSpans"][0]["spans"]] for r in sinks.otlp_json(spans, batch=5, limit=limit).collect()}
        for t in ("a", "b", None, "c"):
            want = [s for s, _ in sorted(((s, at) for x, s, at in rows if x == t), key=lambda r: (r[1], r[0]))]
            assert [got.pop((t, n)) for n in range(-(-len(want) // 5))] == [want[i : i + 5] for i in range(0, len(want), 5)]
        assert not got
    plan = sinks.otlp_json(spans, batch=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_sinks(spark, tmp_path):
    good, _ = source.classify(spark.createDataFrame([("f", i, json.dumps(e)) for i, e in enumerate(scenario())], "file string, seq long, raw string"))
    spans = assemble.build(source.invocations(good)).cache()
    docs = [json.loads(r.value) for r in sinks.otlp_json(spans, batch=4).collect()]
    sizes = [len(d["resourceSpans"][0]["scopeSpans"][0]["spans"]) for d in docs]
    assert max(sizes) == 4 and sum(sizes) == spans.count()
    first = docs[0]["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert set(first) >= {"traceId", "spanId", "name", "kind", "attributes", "status"}
    sinks.write_spans(spans, f"{tmp_path}/spans")
    assert spark.read.parquet(f"{tmp_path}/spans").count() == spans.count()
    sinks.write_otlp_json(spans, f"{tmp_path}/otlp")
    write = sinks.idempotent_sink(f"{tmp_path}/idem")
    write(spans.union(spans), 7)
    write(spans, 7)
    assert spark.read.parquet(f"{tmp_path}/idem").count() == spans.count()
    write(spans, 8)
    write(spans.limit(3), 0)
    assert spark.read.parquet(f"{tmp_path}/idem/batch=8").count() == 0


def test_sink_of_many_batches(spark, tmp_path):
    """A batch reads the keys of its own days alone; a new query overwrites nothing."""
    path, day = f"{tmp_path}/out", 86_400 * 10**9
    row = lambda i, d: (f"t{i}", f"s{i}", d * day, None)
    df = lambda rows: spark.createDataFrame(rows, "trace_id string, span_id string, start_ns long, end_ns long")
    write = sinks.idempotent_sink(path, query="one")
    write(df([row(1, 1), row(2, 2), row(1, 1)]), 0)
    write(df([row(2, 2), row(3, 2)]), 1)
    write(df([row(2, 2), row(3, 2)]), 1)  # run again
    for n in range(2, 5):
        write(df([row(10 + n, n)]), n)
    again = sinks.idempotent_sink(path, query="two")
    again(df([row(1, 1), row(99, 1)]), 0)
    got = spark.read.parquet(path)
    assert sorted(r.span_id for r in got.collect()) == sorted(["s1", "s2", "s3", "s12", "s13", "s14", "s99"])
    assert {r.batch for r in got.select("batch").collect()} == {"0", "1", "2", "3", "4", "two-0"}
    read = []
    real = type(spark.read).parquet
    try:  # which key folders a late batch looks at
        type(spark.read).parquet = lambda self, *paths, **o: (read.append(paths), real(self, *paths, **o))[1]
        write(df([row(50, 3), row(13, 3)]), 5)
    finally:
        type(spark.read).parquet = real
    assert read[0] == (f"{path}/_keys/day=1970-01-04",)
    assert [r.span_id for r in spark.read.parquet(f"{path}/batch=5").collect()] == ["s50"]
