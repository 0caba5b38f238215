"""Instants and durations as BIGINT nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MILLI = 1_000_000_000, 1_000_000


def to_nanos(seconds: Column, nanos: Column) -> Column:
    return seconds.cast("long") * SECOND + F.coalesce(nanos.cast("long"), F.lit(0).cast("long"))


def rfc3339_nanos(text: Column) -> Column:
    """Nanoseconds of an RFC 3339 instant, fraction kept in full; null if it is none."""
    pattern = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,9})[0-9]*)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    part = lambda n: F.regexp_extract(text, pattern, n)
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.replace(F.upper(part(1)), F.lit("T"), F.lit(" ")), F.upper(part(3)))))
    return F.when(F.regexp_like(text, F.lit(pattern)), seconds * SECOND + F.rpad(F.concat(part(2), F.lit("0")), 9, "0").cast("long"))


def duration_ms(seconds: Column, nanos: Column) -> Column:
    """Whole milliseconds, cut off."""
    return seconds.cast("long") * 1000 + (F.coalesce(nanos.cast("long"), F.lit(0).cast("long")) / MILLI).cast("long")


def clamp(start: Column, end: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """Fit an interval into its parent's. One that lies wholly before the parent
    moves to its start and keeps its length, as replayed results of a cache do;
    otherwise both ends are cut, and an interval turned inside out becomes a
    point at its end. Missing bounds do not bind, a missing end stays missing."""
    before = (start < lower) & (end <= lower)
    shifted = lower + F.greatest(end - start, F.lit(0).cast("long"))
    moved_end = F.greatest(F.when(upper.isNull(), shifted).otherwise(F.least(shifted, upper)), lower)
    cut_start = F.when(start.isNotNull(), F.greatest(start, lower))
    cut_end = F.when(end.isNotNull(), F.least(end, upper))
    return F.when(before, lower).when(cut_start > cut_end, cut_end).otherwise(cut_start), F.when(before, moved_end).otherwise(cut_end)


def to_timestamp(nanos: Column) -> Column:
    """For display; instants before the epoch become the epoch."""
    return F.timestamp_micros(F.call_function("div", F.greatest(nanos, F.lit(0).cast("long")), F.lit(1000).cast("long")))


def absolute(nanos: Column, least: int = 10**18) -> Column:
    """The instant, or null where it is too small to be one (before September
    2001 by default), as times counted from a process's start are."""
    return F.when(nanos >= least, nanos)


def sane_start(start: Column, reference: Column, minutes: int = 5) -> Column:
    """The start, or the reference where the two are further apart than that."""
    return F.when(F.abs(start - reference) > minutes * 60 * SECOND, reference).otherwise(start)
