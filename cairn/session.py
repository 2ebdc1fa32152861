"""A session with the settings that the operators are written for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Chunks and containers are large values: fewer of them in a batch.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(name: str = "cairn", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
