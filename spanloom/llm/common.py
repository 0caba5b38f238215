"""What the operators share: staged tables, packed rows and batch helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts delete or split at: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent in a local session (as in tests) a local
    folder is made and set as the checkpoint folder of this session; on a cluster
    the setting must be there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps
    start from the files, so a lost executor costs a re-read and not the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, by: str, *order: str) -> DataFrame:
    """Staged like stage(), bucketed `by` a column and sorted, so that a join on it
    does not move the rows. The table's name goes again at once: the files stay."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(partitions(spark), by).sortBy(by, *order)
     .option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    staged = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return staged


#: At most so many keys are hot, whatever the input.
HOT_KEYS = 10_000


def hot_limit(rows: int) -> int:
    """More than so many of the rows make a key hot: then no more than HOT_KEYS are."""
    return max(100, rows // HOT_KEYS)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, spread: str, count: str, limit: int) -> DataFrame:
    """rows joined to facts, which has a row for every key and how many rows have
    it. Rows of hot keys (above the limit, so HOT_KEYS at most) meet their facts by
    broadcast; in the shuffled join, which serves the others, they are spread by
    another column, so that no key gathers more rows than the limit."""
    told = [c for c in facts.columns if c not in (key, count)]
    hot = facts.filter(F.col(count) > limit).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in told])
    cold = facts.filter(F.col(count) <= limit).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in told])
    met = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    at = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(key, spread).cast(rows.schema[key].dataType))
    both = met.withColumn("_at", at).join(cold, F.col("_at").eqNullSafe(F.col("_cold")), "left")
    of = [F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in told]
    return both.select(*rows.columns, *of)


def pack(docs: DataFrame) -> DataFrame:
    """Each row as one struct `row`, so that no column of the input can clash
    with the columns an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpack(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def text_of(row: str = "row", name: str = "text") -> Column:
    """The text of a packed row; null counts as empty."""
    return F.coalesce(F.col(f"{row}.`{name}`").cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


@cache
def _libc():
    return ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back: workers are kept from stage to stage, and what one
    operator no longer needs should not stand beside the next one's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most max_bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
