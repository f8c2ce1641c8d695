"""A Spark session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **extra: str) -> SparkSession:
    """UTC, adaptive execution on; anything in ``extra`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName("quaymark")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return builder.config(map=settings).getOrCreate()
