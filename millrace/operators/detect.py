"""Projected stock-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HORIZON = 15  # minutes
WINDOW_MINUTES = 5.0


def detect_stockouts(inventory: DataFrame, velocity: DataFrame, horizon: int = HORIZON, latest_only: bool = False, stamped: bool = True) -> DataFrame:
    """Pairs of level and demand that run dry within ``horizon`` minutes; one row for each matching window.

    No demand projects nothing, whatever the level; an empty shelf with demand, or of unknown demand,
    projects zero minutes. The horizon applies before rounding. ``latest_only`` keeps the last window.
    """
    if latest_only:
        velocity = velocity.groupBy("store_id", "sku").agg(F.max_by(F.struct("units_ordered", "order_lines"), "window_start").alias("v")).select("store_id", "sku", "v.*")
    demand = F.col("units_ordered") / F.lit(WINDOW_MINUTES)
    minutes = (F.when(F.col("demand_per_minute") <= 0, F.lit(None).cast("double")).when(F.col("current_level") <= 0, F.lit(0.0))
               .otherwise(F.col("current_level") / F.col("demand_per_minute")))
    own = inventory.join(velocity, ["store_id", "sku"]).withColumn("demand_per_minute", demand).withColumn("_minutes", minutes)
    out = own.where(F.col("_minutes").isNotNull() & (F.col("_minutes") <= horizon)).select(
        "store_id", "sku", "current_level", "units_ordered", "demand_per_minute", F.round("_minutes", 1).alias("minutes_to_stockout"), F.lit(horizon).alias("horizon_minutes"))
    return out.withColumn("detected_at", F.current_timestamp()) if stamped else out


def first_seen(alerts: DataFrame, time: str = "detected_at") -> DataFrame:
    """The first alert of each store and SKU."""
    rest = [c for c in alerts.columns if c not in ("store_id", "sku", time)]
    return alerts.groupBy("store_id", "sku").agg(F.min(F.struct(time, *rest)).alias("a")).select("store_id", "sku", "a.*")
