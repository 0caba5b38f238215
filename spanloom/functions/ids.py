"""Repeatable trace and span ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace_id(uuid: Column) -> Column:
    """32 hex digits: the UUID's, or a digest of anything that is no UUID."""
    plain = F.lower(F.replace(uuid, F.lit("-"), F.lit("")))
    return F.when(F.regexp_like(plain, F.lit("^[0-9a-f]{32}$")), plain).otherwise(F.md5(uuid))


def span_id(trace: Column, kind: str | Column, *key: Column) -> Column:
    """16 hex digits from what identifies the span; null parts count as empty."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    return F.substring(F.sha2(F.concat_ws("\x01", trace, kind, *parts), 256), 1, 16)
