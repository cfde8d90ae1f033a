"""Spark sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the master and sizes come from its own configuration."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
    }
    builder = SparkSession.builder.config(map=settings | (conf or {}))
    return (builder.master(master) if master else builder).getOrCreate()
