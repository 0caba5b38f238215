"""Text expressions: escape codes, byte limits, paths, capped lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "\n...(truncated)\n"
#: The byte limits of an attribute and of a progress record.
ATTRIBUTE_BYTES, PROGRESS_BYTES = 4096, 1 << 20

_ESCAPES = (
    "(?s)\x1b(?:"
    r"\[[^\x40-\x7e]*[\x40-\x7e]?"  # CSI, up to its final byte
    "|\\][^\x07\x1b]*(?:\x07|\x1b\\\\?)?"  # OSC, up to BEL or ESC backslash
    "|.)?"  # two characters, or a stray ESC at the end
)


def strip_ansi(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, F.lit(_ESCAPES), F.lit(""))).otherwise(text)


def bytestream_display(uri: Column) -> Column:
    """The path of a bytestream URI; any other text as it is."""
    return F.regexp_replace(uri, r"(?s)^bytestream://[^/]*/(.+)$", "$1")


def _continues(data: Column, at: Column) -> Column:
    """Whether the byte at a 0-based place is inside a UTF-8 character."""
    return F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")


def truncate_bytes(text: Column, limit: int, suffix: str = "") -> Column:
    """At most `limit` bytes of whole characters, then the suffix; a text that
    fits stays as it is."""
    data = F.encode(text, "UTF-8")
    cut = F.lit(max(0, limit - 3))  # a character has four bytes at most
    for back in (2, 1, 0):
        at = F.lit(max(0, limit - back))
        cut = F.when(~_continues(data, at), at).otherwise(cut)
    whole = F.decode(F.substring(data, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(suffix)))


def tail_bytes(text: Column, limit: int | Column) -> Column:
    """The last `limit` bytes at most, from a whole character on."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    data = F.encode(text, "UTF-8")
    start = F.greatest(F.octet_length(text) - limit, F.lit(0))
    step = F.when(~_continues(data, start), 0).when(~_continues(data, start + 1), 1).when(~_continues(data, start + 2), 2).otherwise(3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, start + step + 1, F.octet_length(text)), "UTF-8"))


def short_path(path: Column) -> Column:
    """The last two segments of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(path)


def argument_after(args: Column, flag: str) -> Column:
    """The argument that follows the first `flag`; null without one."""
    at = F.array_position(args, flag)
    return F.when(at > 0, F.try_element_at(args, (at + 1).cast("int")))


def first_and_count(items: Column, shown: int, sep: str = ", ", total: Column | None = None) -> Column:
    """The first items, joined, and how many more there are. total: how many in
    all, where the list holds the first ones alone."""
    more = (F.size(items) if total is None else total) - shown
    return F.concat(F.array_join(F.slice(items, 1, shown), sep), F.when(more > 0, F.concat(F.lit(f"{sep}... and "), more.cast("string"), F.lit(" more"))).otherwise(""))
