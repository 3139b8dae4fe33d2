"""Command line: ``python -m millrace.cli JOB ...``."""

from __future__ import annotations

import argparse
import json
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from millrace.plans.batch import run_backfill, run_features
from millrace.plans.lake import LakeTable
from millrace.plans.serving import export
from millrace.session import build_session
from millrace.sources.generator import EventFactory, iter_events
from millrace.sources.readers import read_files, read_topic
from millrace.sources.schemas import TOPICS
from millrace.streaming import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="job", required=True)
    for name in ("bronze", "silver", "gold"):
        p = sub.add_parser(name)
        p.add_argument("--base-path", required=True)
        p.add_argument("--checkpoint-base", required=True)
        if name == "bronze":
            p.add_argument("--bootstrap", required=True)
    p = sub.add_parser("backfill")
    for a in ("--raw-path", "--silver-path", "--process-date"):
        p.add_argument(a, required=True)
    p = sub.add_parser("features")
    for a in ("--silver-orders", "--feature-path"):
        p.add_argument(a, required=True)
    p = sub.add_parser("produce")
    p.add_argument("--out", required=True, help="file that gets one JSON object a line: topic, key, value")
    p.add_argument("--events-per-sec", type=float, default=50)
    p.add_argument("--duration", type=float, default=10)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--late-fraction", type=float, default=0.05)
    p.add_argument("--rain-surge", action="store_true")
    p = sub.add_parser("load")
    for a in ("--source", "--target", "--partition-field"):
        p.add_argument(a, required=True)
    p.add_argument("--clustering", default="")
    p.add_argument("--replace-partition")
    return top


def produce(a: argparse.Namespace) -> dict[str, int]:
    """Write events at the asked rate; returns counts by topic."""
    factory, counts = EventFactory(a.seed, a.late_fraction, a.rain_surge), dict.fromkeys(TOPICS, 0)
    until = time.monotonic() + a.duration
    with open(a.out, "w") as f:
        while time.monotonic() < until:
            for topic, event in iter_events(factory, datetime.now(timezone.utc)):
                f.write(json.dumps({"topic": topic, "key": event["store_id"], "value": event}) + "\n")
                counts[topic] += 1
            time.sleep(1 / a.events_per_sec)
    return counts


def _table(spark, path: str) -> DataFrame:
    lake = LakeTable(spark, path)
    return lake.read() if lake.exists() else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.job == "produce":
        print(json.dumps(produce(a)))
        return
    spark = build_session(f"millrace-{a.job}")
    if a.job == "bronze":
        for topic in TOPICS:
            jobs.start_bronze(read_topic(spark, a.bootstrap, topic), topic, a.base_path, a.checkpoint_base)
    elif a.job == "silver":
        for topic in TOPICS:
            jobs.start_silver(jobs.bronze_table(spark, a.base_path, topic).stream(), topic, a.base_path, a.checkpoint_base)
    elif a.job == "gold":
        jobs.start_zone_windows(jobs.silver_table(spark, a.base_path, "orders").stream(), a.base_path, a.checkpoint_base)
        jobs.start_inventory(jobs.silver_table(spark, a.base_path, "inventory_updates").stream(), a.base_path, a.checkpoint_base)
    elif a.job == "backfill":
        run_backfill(_table(spark, a.raw_path), LakeTable(spark, a.silver_path), a.process_date)
    elif a.job == "features":
        run_features(_table(spark, a.silver_orders), a.feature_path)
    elif a.job == "load":
        export(read_files(spark, a.source), a.target, a.partition_field, [c for c in a.clustering.split(",") if c], a.replace_partition)
    if a.job in ("bronze", "silver", "gold"):
        spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
