"""Sessions as the engine wants them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corvid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive plans, UTC and Arrow; on a cluster the submitted settings win."""
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
