"""One way to make the SparkSession that tests, benchmarks and jobs share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A UTC session with adaptive execution; ``settings`` use __ for the dots of a key."""
    builder = SparkSession.builder.master(master).appName("leadmill")
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
