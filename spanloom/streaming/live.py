"""Live feeds: events as a stream, traces by keyed state, progress without state.

The state of an invocation is its raw events: they wait until its last message
(plus a drain time) or until it falls idle, and come out together; the batch
operators then build the trace inside foreachBatch. So the live result equals the
batch result by construction, late spawns within the drain time count, and the
state of a key is bounded by one build."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text
from ..functions.redact import Redactor
from ..operators import assemble
from ..sources import events as source
from ..sources import exec_log

#: Arrival schema: stream, sequence number, arrival time, the event's JSON.
EVENT = "file string, seq long, at timestamp, raw string"
RELEASED = T.StructType([T.StructField("file", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("reason", T.StringType())])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100, schema: str = EVENT) -> DataFrame:
    """A directory of Parquet files as a stream; late files are picked up."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Sources replay; sequence numbers make a repeated event recognisable."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["file", "seq"])


def read_entries(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Execution-log lines as a stream: inv, seq, at, raw. Files may come late."""
    return spark.readStream.schema("inv string, seq long, at timestamp, raw string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress(stream: DataFrame, redactor: Redactor = Redactor()) -> DataFrame:
    """One log record per progress event, at once and without state."""
    parsed = stream.withColumn("v", F.try_parse_json("raw"))
    get = lambda p: text.tail_bytes(redactor.text(text.strip_ansi(F.coalesce(F.try_variant_get("v", p, "string"), F.lit("")))), text.PROGRESS_BYTES)
    both = parsed.select("file", "seq", "at", get("$.progress.stdout").alias("stdout"), get("$.progress.stderr").alias("stderr"))
    return both.filter("stdout <> '' or stderr <> ''")


class Collector(StatefulProcessor):
    """Holds the events of one stream until it is over."""

    def __init__(self, drain_ms: int, idle_ms: int) -> None:
        self.drain_ms, self.idle_ms = drain_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", T.StructType([T.StructField("seq", T.LongType()), T.StructField("raw", T.StringType())]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType()), T.StructField("last", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, newest, fresh = False, 0, []
        for frame in rows:
            fresh += [(int(s), r) for s, r in zip(frame["seq"], frame["raw"], strict=True)]
            newest = max(newest, int(frame["at"].max().timestamp() * 1000))
            last |= bool(frame["last"].any())
        self.rows.appendList(fresh)
        old = self.due.get() if self.due.exists() else None
        last |= bool(old and old[1])
        when = newest + (self.drain_ms if last else self.idle_ms)
        if old and old[1]:
            when = old[0]  # the drain time runs from the last message
        if old:
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(when)
        self.due.update((when, last))
        yield pd.DataFrame(columns=RELEASED.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get())
        over = self.due.get()[1]
        self.rows.clear()
        self.due.clear()
        yield pd.DataFrame({"file": key[0], "seq": [r[0] for r in held], "raw": [r[1] for r in held], "reason": "last message" if over else "idle"})

    def close(self) -> None:
        pass


def released(stream: DataFrame, drain_ms: int = 2300, idle_ms: int = 3_600_000, delay: str | None = None) -> DataFrame:
    """Whole streams, once they are over or idle. An event-time timer needs the
    watermark to move, so a quiet feed needs a heartbeat row to end its last key.
    delay: the watermark, for a stream that has none yet (deduplicated() sets one)."""
    last = F.coalesce(F.get_json_object("raw", "$.lastMessage") == "true", F.lit(False))
    timed = stream.withColumn("last", last) if delay is None else stream.withColumn("last", last).withWatermark("at", delay)
    return timed.groupBy("file").transformWithStateInPandas(statefulProcessor=Collector(drain_ms, idle_ms), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")


def traces_to(write: Callable[[DataFrame, int], None], options: assemble.Options = assemble.Options(), entries: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over released(): build the traces of the streams in the
    batch with the batch operators and hand the spans to `write`. entries gives
    the execution-log lines (inv, seq, raw) collected so far; those of the batch's
    invocations take part."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        good, _ = source.classify(batch.select("file", "seq", "raw"))
        events = source.bronze(source.invocations(good))
        lines = entries(batch.sparkSession).join(events.select("inv").distinct(), "inv", "left_semi") if entries else None
        spawns = exec_log.spawns(exec_log.entries(lines), strict=False) if entries else None
        write(assemble.build(events, spawns, options), number)

    return run
