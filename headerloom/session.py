"""Session settings that the library expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "headerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Pass ``master`` for local work only."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
