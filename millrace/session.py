"""Spark session for the engine's jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "millrace", **conf: str) -> SparkSession:
    """UTC, adaptive execution, RocksDB state with schema checks; ``conf`` overrides (dots as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.stateSchemaCheck": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
