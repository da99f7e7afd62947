"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidegauge", **settings: str) -> SparkSession:
    """UTC, adaptive execution; settings override or add, with __ for the dots of a name."""
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
