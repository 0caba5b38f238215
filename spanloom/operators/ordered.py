"""Computations in arrival order: every input row carries `seq`, which stands for
its place in the stream. All windows are per stream or invocation, and those of
one step share partitioning and order, so that one exchange serves them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import TRUNCATED, tail_bytes
from .staging import stage


def running(keys: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cut_after_last(df: DataFrame, keys: list[str], last: Column, order: list) -> DataFrame:
    """Rows up to each stream's first last-message row, that row included."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_closed", F.coalesce(F.max(last.cast("int")).over(before), F.lit(0))).filter("_closed = 0").drop("_closed")


def split_invocations(df: DataFrame, keys: list[str], started: Column, order: list, name: str = "invocation") -> DataFrame:
    """Number the invocations of a stream: each start opens the next; rows before
    the first belong to 0."""
    return df.withColumn(name, F.sum(F.coalesce(started.cast("int"), F.lit(0))).over(running(keys, order)))


def as_of(df: DataFrame, keys: list[str], value: Column, order: list, name: str) -> DataFrame:
    """The last value known at each row, itself included."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(running(keys, order)))


def in_force(rows: DataFrame, changes: DataFrame, keys: list[str], seq: str, since: str, value: str) -> DataFrame:
    """rows with `value`, the last one that changes (keys, since, value) set at or
    before their seq, null before the first. Changes are few: they alone are sorted,
    into intervals, and meet the rows of their key in a hash join; rows are not
    sorted, and those of a key that holds many are split by the skew join."""
    after = Window.partitionBy(*keys).orderBy(since)
    spans = changes.groupBy(*keys, since).agg(F.max(value).alias(value)).withColumn("_until", F.lead(since).over(after))
    facts = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(since).alias("_since"), "_until", F.col(value).alias("_value"))
    at = (F.col("_since") <= F.col(seq)) & (F.col("_until").isNull() | (F.col("_until") > F.col(seq)))
    for k in keys:
        at = at & (F.col(k) == F.col(f"_k_{k}"))
    return rows.join(facts.hint("shuffle_hash"), at, "left").select(*rows.columns, F.col("_value").alias(value))


def numbered(rows: DataFrame, key: str, order: list[Column], name: str, keep: list[str] | None = None, by: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """rows with their number within the key, by a sort over ranges: a key with most
    of the rows lies in many ranges, and what each has before it comes from counts.
    Staged once sorted (`by` the function that does it), so numbers and rows see the
    same places; of the columns only those to keep are, if they are given."""
    kept = [*(keep or rows.columns)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = by(rows.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*kept, F.monotonically_increasing_id().alias("_at"))).withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ahead = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"))
    met = placed.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return met.select(*kept, (F.col("_at") + F.col("_ahead") + 1).alias(name))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as an overwritten map entry. Aggregated before
    the shuffle, so a hot key is one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def merge_attributes(rows: DataFrame, keys: list[str], key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Attribute writes merged, later ones win: one map a key set."""
    last = rows.groupBy(*keys, key).agg(F.max_by(value, F.struct(seq, value)).alias(value))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("attrs"))


def running_bytes(df: DataFrame, keys: list[str], text: str, order: list, name: str, newest_first: bool = False) -> DataFrame:
    """Bytes up to and with each row."""
    order = [F.desc(c) for c in order] if newest_first else order
    return df.withColumn(name, F.sum(F.octet_length(text).cast("long")).over(running(keys, order)))


def tail(df: DataFrame, keys: list[str], text: str, order: list[str], limit: int, marker: str = TRUNCATED) -> DataFrame:
    """keys, tail and chunks (the rows it comes from): the last bytes of each key's
    texts put together, from a whole character on. Where something had to go the
    marker stands in front, and the limit counts it. Rows wholly outside the limit
    go before any list is made, so a list holds `limit` bytes at most.

    Rows are sorted over ranges, newest first, and only ranges that begin within the
    limit are looked at further: of a key with very many rows, a range or two."""
    filled = df.select(*keys, *order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own, newest = F.octet_length("_text"), [F.desc(o) for o in [*order, "_text"]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stage(filled.repartitionByRange(parts, *keys, *newest).sortWithinPartitions(*keys, *newest).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*keys, "_range").agg(F.sum(own.cast("long")).alias("_bytes"))
    newer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    close = sizes.withColumn("_newer", F.coalesce(F.sum("_bytes").over(newer), F.lit(0))).filter(F.col("_newer") <= limit)
    same = (F.col("_range") == F.col("_of")) & reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    filled = ranges.join(close.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_of")), same, "left_semi").drop("_range")
    near = running_bytes(filled, keys, "_text", [*order, "_text"], "_upto", newest_first=True).filter(F.col("_upto") - own <= limit)
    cut = tail_bytes(F.col("_text"), (limit - (F.col("_upto") - own)).cast("int"))
    lists = near.select(*keys, *order, "_upto", F.when(F.col("_upto") > limit, cut).otherwise(F.col("_text")).alias("_text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_text"))), lambda c: c["_text"]), "")
    grouped = lists.groupBy(*keys).agg(whole.alias("_whole"), F.max("_upto").alias("_total"), F.count("*").alias("chunks"))
    short = F.concat(F.lit(marker), tail_bytes(F.col("_whole"), max(0, limit - len(marker.encode()))))
    return grouped.select(*keys, F.when(F.col("_total") > limit, short).otherwise(F.col("_whole")).alias("tail"), "chunks")


def slowest(df: DataFrame, keys: list[str], duration: Column, n: int, ties: list[str]) -> DataFrame:
    """The n longest rows of each key."""
    order = Window.partitionBy(*keys).orderBy(duration.desc(), *ties)
    top = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)  # on the bare number: limits each group before the shuffle
    return top.withColumn("rank", F.col("rank").cast("long"))
