"""Redaction of secrets in command lines, named values and text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "***"
#: Flags whose NAME=VALUE half can carry a secret.
FLAGS = ("--client_env=", "--action_env=", "--test_env=", "--repo_env=", "--host_action_env=", "--define=")
#: Parts of names, in any case, that mark a value as secret.
NAMES = ("TOKEN", "SECRET", "PASSWORD", "PASSWD", "CREDENTIAL", "COOKIE", "APIKEY", "API_KEY", "ACCESS_KEY", "PRIVATE_KEY", "AUTH")
_BLANK = r" \t\n\f\r"  # ASCII white space


@dataclass(frozen=True)
class Redactor:
    """names: substrings that make a name sensitive; an empty tuple turns
    redaction off."""

    names: tuple[str, ...] = NAMES

    @property
    def enabled(self) -> bool:
        return bool(self.names)

    def _flag(self, name_char: str) -> str:
        flags = "|".join(map(re.escape, FLAGS))
        parts = "|".join(map(re.escape, self.names))
        return rf"(?:{flags})(?={name_char}*?(?:{parts}))"

    def arg(self, arg: Column) -> Column:
        """One argument: the value after NAME= goes if NAME is sensitive. A name
        ends at its first equals sign; without one there is no value to hide."""
        if not self.enabled:
            return arg
        return F.regexp_replace(arg, F.lit(rf"(?isu)^({self._flag('[^=]')}[^=]*)=.*$"), F.lit(f"$1={HIDDEN}"))

    def args(self, args: Column) -> Column:
        return F.transform(args, self.arg) if self.enabled else args

    def text(self, text: Column) -> Column:
        """Every token between ASCII white space as one argument."""
        if not self.enabled:
            return text
        token = rf"[^={_BLANK}]"
        pattern = rf"(?isu)(?<=^|[{_BLANK}])({self._flag(token)}{token}*)=[^{_BLANK}]*"
        return F.regexp_replace(text, F.lit(pattern), F.lit(f"$1={HIDDEN}"))

    def named(self, name: Column, value: Column) -> Column:
        if not self.enabled:
            return value
        pattern = "(?iu)" + "|".join(map(re.escape, self.names))
        return F.when(F.regexp_like(name, F.lit(pattern)), F.lit(HIDDEN)).otherwise(value)

    def map(self, values: Column) -> Column:
        return F.transform_values(values, self.named) if self.enabled else values


def redact_table(df: DataFrame, args: tuple[str, ...] = (), texts: tuple[str, ...] = (), maps: tuple[str, ...] = (), redactor: Redactor = Redactor()) -> tuple[DataFrame, DataFrame]:
    """The table with secrets hidden, and an audit: rows changed by column."""
    new = {c: redactor.args(F.col(c)) for c in args} | {c: redactor.text(F.col(c)) for c in texts} | {c: redactor.map(F.col(c)) for c in maps}
    changed = [F.struct(F.lit(c).alias("column"), (F.to_json(F.struct(v)) != F.to_json(F.struct(F.col(c).alias("v")))).cast("long").alias("hit")) for c, v in ((c, v.alias("v")) for c, v in new.items())]
    audit = df.select(F.explode(F.array(*changed)).alias("e")).groupBy("e.column").agg(F.coalesce(F.sum("e.hit"), F.lit(0)).alias("rows_redacted"))
    return df.withColumns(new), audit
