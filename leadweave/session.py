"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "leadweave", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; the caller's settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map={**settings, **conf}).getOrCreate()
