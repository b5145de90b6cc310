"""SparkSession with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "hydrograin", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map={**SETTINGS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()
