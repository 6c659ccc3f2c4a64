"""The session every entry point uses."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "barloom", **settings: str) -> SparkSession:
    """The active session, or one with UTC time, adaptive execution and Arrow transfer."""
    return SparkSession.builder.appName(app).config(map=SETTINGS | settings).getOrCreate()


def reach_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. On a cluster, install it on every node."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
