"""Batch jobs: nightly backfill of one event day, feature build, the gated daily sequence."""

from __future__ import annotations

import time
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rules import TOPIC_RULES, split
from millrace.operators.aggregates import orders_by_zone_window
from millrace.operators.dedup import dedup_latest
from millrace.operators.features import build_features
from millrace.operators.quality import run_gate
from millrace.plans.lake import LakeTable
from millrace.plans.serving import export


def event_day(df: DataFrame, day: date | str, ingest_lag_days: int | None = None) -> DataFrame:
    """Rows whose event time falls on ``day``, late arrivals included.

    ``ingest_lag_days`` also bounds the ingest date, which prunes partitions but loses later rows.
    """
    out = df.withColumn("event_date", F.to_date("event_time")).where(F.col("event_date") == F.lit(str(day)).cast("date"))
    if ingest_lag_days is not None:
        first = date.fromisoformat(str(day))
        out = out.where(F.col("_ingest_date").between(F.lit(str(first)).cast("date"), F.lit(str(first + timedelta(days=ingest_lag_days))).cast("date")))
    return out


def corrected_day(raw: DataFrame, day: date | str, topic: str | None = "orders", key: str = "event_id", order: str = "ingest_time", ties: list[str] | None = None) -> DataFrame:
    """Rows of ``day``: validated by the topic's rules (None: as they are), then the latest of each key."""
    own = event_day(raw, day)
    if topic is not None:
        own = split(own, TOPIC_RULES[topic]())[0]
    return dedup_latest(own, key, order, ties)


def run_backfill(raw: DataFrame, silver: LakeTable, day: date | str, topic: str | None = "orders") -> int:
    """Replace ``day`` in the clean table, also if nothing is left of it; rerunning gives the same rows."""
    silver.partition_by = ("event_date",)
    return silver.overwrite_partitions(corrected_day(raw, day, topic), partitions=[{"event_date": str(day)}], merge_schema=True)


def write_day(df: DataFrame, path: str, partition: str = "event_date") -> None:
    """Plain Parquet variant: dynamic partition overwrite, set on the writer and not on the session."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def run_features(silver_orders: DataFrame, path: str) -> None:
    write_day(build_features(silver_orders), path, "feature_date")


def retried(step, times: int = 2, first_wait: float = 1.0):
    """Run ``step``; after an error wait, twice as long each time, and try again."""
    for k in range(times + 1):
        try:
            return step()
        except Exception:
            if k == times:
                raise
            time.sleep(first_wait * 2**k)


def run_daily(spark: SparkSession, raw: DataFrame, silver: LakeTable, gold: LakeTable, day: date | str, now, serving: str, retries: int = 2, pre_check: bool = True) -> list:
    """Pre-check, backfill, gold of the day anew, post-check (never retried), serving copy of the day."""
    if pre_check and gold.exists():
        retried(lambda: run_gate(gold.read(), str(day), now, "pre-check"), retries)
    retried(lambda: run_backfill(raw, silver, day), retries)
    gold.partition_by = ("event_date",)

    def rebuild() -> None:
        windows = orders_by_zone_window(silver.read(where={"event_date": day}))
        gold.overwrite_partitions(windows.withColumn("event_date", F.to_date("window_start")), partitions=[{"event_date": str(day)}])

    retried(rebuild, retries)
    results = run_gate(gold.read(), str(day), now, "post-check")
    retried(lambda: export(gold.read(where={"event_date": day}).drop("event_date"), serving, "window_start", ["zone", "city"], day), retries)
    return results
