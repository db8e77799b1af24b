"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, name: str = "quarry", **conf) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow transfer. Partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
