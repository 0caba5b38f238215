"""Span status and the names of enumerated values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, ERROR, UNSET = "Ok", "Error", "Unset"

#: The wire enumerations, in their order.
TEST_STATUS = ("NO_STATUS", "PASSED", "FLAKY", "TIMEOUT", "FAILED", "INCOMPLETE", "REMOTE_FAILURE", "FAILED_TO_BUILD", "TOOL_HALTED_BEFORE_TESTING")
ABORT_REASON = ("UNKNOWN", "USER_INTERRUPTED", "TIME_OUT", "REMOTE_ENVIRONMENT_FAILURE", "INTERNAL", "LOADING_FAILURE", "ANALYSIS_FAILURE", "SKIPPED", "NO_ANALYZE", "NO_BUILD", "INCOMPLETE", "OUT_OF_MEMORY")
TEST_SIZE = ("UNKNOWN", "SMALL", "MEDIUM", "LARGE", "ENORMOUS")
DOWNLOADER = ("UNKNOWN", "HTTP", "GRPC")


def enum_name(code: Column, names: tuple[str, ...], other: str = "UNKNOWN") -> Column:
    """The name of a 0-based code; names pass through."""
    at = F.get(F.array(*map(F.lit, names)), F.try_to_number(code.cast("string"), F.lit("999")).cast("int"))
    return F.when(code.cast("string").isin(*names), code.cast("string")).otherwise(F.coalesce(at, F.lit(other)))


def _status(code: Column, description: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(code.alias("code"), (F.when(code == ERROR, description) if description is not None else none).alias("description"))


def root_status(exit_code: Column) -> Column:
    return _status(F.when(exit_code == 0, OK).when(exit_code.isNotNull(), ERROR).otherwise(UNSET), F.concat(F.lit("exit code "), exit_code.cast("string")))


def success_status(success: Column, failed: str) -> Column:
    return _status(F.when(success, OK).when(~success, ERROR).otherwise(UNSET), F.lit(failed))


def test_status(status: Column) -> Column:
    """Passed tests alone are fine; flaky ones are errors."""
    return _status(F.when(status == "PASSED", OK).when(status.isNotNull(), ERROR).otherwise(UNSET), status)


def spawn_status(exit_code: Column, status: Column) -> Column:
    bad = (F.coalesce(exit_code, F.lit(0)) != 0) | (F.coalesce(status, F.lit("")) != "")
    return _status(F.when(bad, ERROR).otherwise(UNSET), F.concat(F.lit("exit_code="), F.coalesce(exit_code, F.lit(0)).cast("string"), F.lit(" status="), F.coalesce(status, F.lit(""))))


def aborted_status(description: Column) -> Column:
    return _status(F.lit(ERROR), F.coalesce(F.nullif(description, F.lit("")), F.lit("aborted")))


def mode_description(mode: Column) -> Column:
    return F.when(mode == "full", "full: every action").otherwise("lightweight: failed actions only")
