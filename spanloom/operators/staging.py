"""Staged tables: lineage is cut by what is written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: How many files of a partitioned table a task keeps open before it sorts its rows.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

#: Whether the shuffle files of a job go with it, not when the driver happens to collect its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows in memory take up to this many times their files, as measured on keys of traces (16, and half the bytes by zstd).
_FACTOR, _TIMES = "spark.sql.sources.fileCompressionFactor", 32.0

#: What passing() has to release: the folders that were staged inside.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def _set(spark: SparkSession, **conf: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage with a table in the folder of spark.checkpoint.dir, partitioned
    `by` a column if given (few values: a task keeps a file open for each, and need
    not sort its rows). A local session without that setting, as in tests, gets
    a folder of its own; on a cluster the setting must be there.

    Once the table is written, the shuffle files of its job go: nothing reads them
    again, and a query of many staged tables takes the disk of one job at a time.

    Spark plans a broadcast by the size of files; staged keys are far larger in
    memory than there, so the session's factor between the two is raised. What is
    small indeed is still broadcast, by its size at run time."""
    spark = df.sparkSession
    if float(spark.conf.get(_FACTOR)) < _TIMES:
        spark.conf.set(_FACTOR, str(_TIMES))
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    if (inside := _PASSING.get()) is not None:
        inside.append(path)
    with _set(spark, **{_CLEANUP: "true"} | ({_WRITERS: "32"} if by else {})):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside passes: its folders are deleted at the end, but for
    tables staged by the function that this gives. What leaves the block must read
    those only, and no frame from inside may be used after it."""
    inside: list[str] = []
    outside = _PASSING.get()
    token = _PASSING.set(inside)

    def keep(df: DataFrame) -> DataFrame:
        kept = stage(df)
        path = inside.pop()
        if outside is not None:
            outside.append(path)
        return kept

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in inside:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
