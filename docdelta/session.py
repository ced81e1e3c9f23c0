"""Sessions with the settings that the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "docdelta", **conf: str) -> SparkSession:
    """A session with adaptive plans and skew handling; conf overrides, with dots as underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
