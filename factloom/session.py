"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "factloom", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's own choice."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
