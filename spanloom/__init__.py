"""Build-event traces and analytics on Spark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver
    was started from; elsewhere it must be installed or passed by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
