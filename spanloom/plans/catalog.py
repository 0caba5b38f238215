"""All registered queries and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import event_queries, kind_queries, queries as _queries, state_queries  # the others add to the same registry


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries.span_tree(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert event_queries.query is kind_queries.query is state_queries.query is _queries.query
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.SQL)
