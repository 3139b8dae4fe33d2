"""Keep-latest and bounded-state de-duplication, latest state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, key: list[str] | str = "event_id", order: str = "ingest_time", ties: list[str] | None = None) -> DataFrame:
    """One row a key: the latest by ``order``, nulls last; ``ties`` (else all other columns) settle equal times.

    Spark plans a rank limit on both sides of the exchange, so a hot key is cut down before it.
    """
    keys = [key] if isinstance(key, str) else key
    rest = ties if ties is not None else [c for c, t in df.dtypes if c not in {*keys, order} and not t.startswith(("map", "variant"))]
    by = [F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedup_stream(df: DataFrame, key: str = "event_id", time: str = "event_time", watermark: str = "10 minutes") -> DataFrame:
    """Streams: repeats within the watermark go; state is bounded by it."""
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def latest_by_key(df: DataFrame, keys: list[str], order: str, values: dict[str, str]) -> DataFrame:
    """Latest values a key: one partial aggregation instead of a sort. ``values``: output name to column.

    A null ``order`` counts as the earliest; equal times are settled by the values.
    """
    packed = F.max(F.struct(F.col(order).alias("_o"), *[F.col(v).alias(k) for k, v in values.items()]))
    return df.groupBy(*keys).agg(packed.alias("_m")).select(*keys, *[F.col(f"_m.{k}").alias(k) for k in values], F.col("_m._o").alias("as_of"))


def latest_inventory(updates: DataFrame) -> DataFrame:
    """Current level by store and SKU."""
    return latest_by_key(updates, ["store_id", "sku"], "event_time", {"current_level": "new_level"})
