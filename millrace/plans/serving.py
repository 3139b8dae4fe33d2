"""Serving copy: one day, partitioned by date, sorted by the clustering columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition_address(table: str, day: date | str | None = None) -> str:
    """``table`` or ``table$YYYYMMDD``."""
    return table if day is None else f"{table}${str(day).replace('-', '')}"


def export(df: DataFrame, path: str, time_column: str, cluster_by: list[str], day: date | str | None = None) -> None:
    """Replace one day's partition if ``day`` is given (only its rows), else add all rows."""
    own = df.withColumn("_day", F.to_date(time_column))
    if day is not None:
        own = own.where(F.col("_day") == F.lit(str(day)).cast("date"))
    out = own.repartition("_day").sortWithinPartitions("_day", *cluster_by).write.partitionBy("_day")
    if day is not None:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        out.mode("append").parquet(path)
