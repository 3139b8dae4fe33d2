"""Streaming jobs from topics to raw, clean, refused and aggregated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.functions.parse import parse_topic
from millrace.functions.rules import TOPIC_RULES, add_column_if_missing, split, stamp_dead_letters
from millrace.operators.aggregates import orders_by_zone_window
from millrace.operators.dedup import dedup_stream, latest_inventory
from millrace.operators.detect import detect_stockouts
from millrace.plans.lake import LakeTable
from millrace.sources.schemas import TOPICS

TRIGGERS = {"bronze": "10 seconds", "silver": "10 seconds", "gold": "30 seconds"}


def _trigger(layer: str, once: bool) -> dict:
    return {"availableNow": True} if once else {"processingTime": TRIGGERS[layer]}


def _append(df: DataFrame, target: LakeTable, name: str, checkpoint: str, layer: str, once: bool, merge_schema: bool = False) -> StreamingQuery:
    """Append each micro-batch in one commit under (name, batch id)."""

    def land(batch: DataFrame, batch_id: int) -> None:
        target.append(batch, merge_schema=merge_schema, commit=(name, batch_id))

    return df.writeStream.queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(**_trigger(layer, once)).foreachBatch(land).start()


def bronze_table(spark: SparkSession, base: str, topic: str) -> LakeTable:
    return LakeTable(spark, f"{base}/bronze_{topic}", ("_ingest_date",))


def silver_table(spark: SparkSession, base: str, topic: str) -> LakeTable:
    return LakeTable(spark, f"{base}/silver_{topic}", ("event_date",))


def start_bronze(wire: DataFrame, topic: str, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _append(parse_topic(wire, TOPICS[topic]), bronze_table(wire.sparkSession, base, topic), f"bronze_{topic}", checkpoint, "bronze", once)


def clean_topic(bronze: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Validation first, then de-duplication of the clean side only."""
    clean, dead = split(bronze, TOPIC_RULES[topic]())
    return dedup_stream(clean), dead


def start_silver(bronze: DataFrame, topic: str, base: str, checkpoint: str, once: bool = False, new_column: str | None = None) -> list[StreamingQuery]:
    """Two queries: clean rows by event date, and refused rows into the table all topics share."""
    spark = bronze.sparkSession
    clean, dead = clean_topic(bronze, topic)
    clean = add_column_if_missing(clean, new_column).withColumn("event_date", F.to_date("event_time"))
    refused = LakeTable(spark, f"{base}/dead_letter")
    return [_append(clean, silver_table(spark, base, topic), f"silver_{topic}", checkpoint, "silver", once, merge_schema=True),
            _append(stamp_dead_letters(dead, topic), refused, f"dead_letter_{topic}", checkpoint, "silver", once, merge_schema=True)]


def start_zone_windows(orders: DataFrame, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    target = LakeTable(orders.sparkSession, f"{base}/gold_orders_by_zone_5min", ("zone",))
    return _append(orders_by_zone_window(orders), target, "gold_orders_by_zone_5min", checkpoint, "gold", once)


def upsert_inventory(target: LakeTable, buckets: int = 16):
    """The foreachBatch callback that keeps the current level by store and SKU."""

    def land(batch: DataFrame, batch_id: int) -> None:
        target.upsert(latest_inventory(batch), ["store_id", "sku"], "as_of", buckets, commit=("gold_store_sku_inventory", batch_id))

    return land


def start_inventory(updates: DataFrame, base: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    target = LakeTable(updates.sparkSession, f"{base}/gold_store_sku_inventory")
    return (updates.writeStream.queryName("gold_store_sku_inventory").option("checkpointLocation", f"{checkpoint}/gold_store_sku_inventory")
            .trigger(**_trigger("gold", once)).foreachBatch(upsert_inventory(target)).start())


def run_detector(spark: SparkSession, base: str, velocity: DataFrame, latest_only: bool = True) -> int:
    """Scheduled batch job: append the alerts that the current levels and demand give."""
    alerts = detect_stockouts(LakeTable(spark, f"{base}/gold_store_sku_inventory").read().drop("as_of"), velocity, latest_only=latest_only)
    target = LakeTable(spark, f"{base}/stockout_alerts", ("alert_date",))
    return target.append(alerts.withColumn("alert_date", F.to_date("detected_at")))


class Progress(StreamingQueryListener):
    """Keeps the fields that show whether a stream falls behind."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        return

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "in_rate": p.inputRowsPerSecond, "out_rate": p.processedRowsPerSecond,
                          "state_rows": sum(s.numRowsTotal for s in p.stateOperators)})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        return
