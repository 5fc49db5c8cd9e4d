"""Session defaults: UTC, adaptive execution with skew joins; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lodeweave", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
