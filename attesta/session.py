"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "attesta", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else comes from the cluster or ``conf``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
