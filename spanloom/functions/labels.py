"""Build labels: normal form, short form, external repositories, span names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import argument_after, short_path


def normalize_label(label: Column) -> Column:
    return F.regexp_replace(label, "^@+", "")


def shorten_label(label: Column) -> Column:
    """`@@x` gives `x`; `@repo//p` gives `//p`; anything else stays."""
    at = F.instr(label, "//")
    return F.when(F.startswith(label, F.lit("@@")), F.substr(label, F.lit(3))).when(F.startswith(label, F.lit("@")) & (at > 0), F.substr(label, at)).otherwise(label)


def is_external(label: Column) -> Column:
    return F.startswith(label, F.lit("@")) | F.contains(label, F.lit("+_repo_rules+"))


def root_name(command: Column, patterns: Column | None = None, tool: str = "bazel") -> Column:
    return F.concat_ws(" ", F.lit(tool), command, *([] if patterns is None else [F.when(F.size(patterns) > 0, F.array_join(patterns, " "))]))


def target_name(label: Column) -> Column:
    return F.concat(F.lit("target "), shorten_label(label))


def fetch_name(url: Column) -> Column:
    return F.concat(F.lit("fetch "), url)


def action_name(mnemonic: Column, label: Column, orphan: Column | None = None) -> Column:
    """`action`, then mnemonic and short label where given; orphans are marked."""
    name = F.concat_ws(" ", F.lit("action"), F.nullif(mnemonic, F.lit("")), F.nullif(shorten_label(label), F.lit("")))
    return name if orphan is None else F.when(orphan, F.concat(name, F.lit(" (synth)"))).otherwise(name)


def test_name(label: Column, attempt: Column, run: Column, shard: Column) -> Column:
    inner = F.concat_ws(" ", F.concat(F.lit("attempt="), attempt.cast("string")), F.when(run.isNotNull() & shard.isNotNull(), F.concat(F.lit("run="), run.cast("string"), F.lit(" shard="), shard.cast("string"))))
    return F.concat(F.lit("test "), shorten_label(label), F.when(attempt.isNotNull(), F.concat(F.lit(" ["), inner, F.lit("]"))).otherwise(""))


def spawn_name(mnemonic: Column, args: Column, listed: Column, actual: Column) -> Column:
    """`spawn`, the mnemonic, and the source of a compile or the first output."""
    source = F.when(F.contains(mnemonic, F.lit("Compile")) | F.contains(mnemonic, F.lit("compile")), argument_after(args, "-c"))
    output = F.coalesce(F.try_element_at(listed, F.lit(1)), F.try_element_at(actual, F.lit(1)))
    return F.concat_ws(" ", F.lit("spawn"), F.coalesce(F.nullif(mnemonic, F.lit("")), F.lit("unknown")), short_path(F.coalesce(source, output)))


def spawn_candidates(listed: Column, actual: Column) -> Column:
    """Outputs under which a spawn may know its action, best first: the listed
    ones, then actual ones not among them; the empty output where there is none."""
    extra = F.array_distinct(F.filter(F.array_except(actual, listed), lambda p: p != ""))
    every = F.concat(listed, extra)
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit("")))
