"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "barloom", **more: str) -> SparkSession:
    """UTC, ANSI arithmetic and adaptive execution; `more` adds settings (underscores become dots)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in more.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
