"""A Spark session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tallygrove", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, Arrow; ANSI stays on. Further settings override."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
