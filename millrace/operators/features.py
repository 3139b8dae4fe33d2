"""Point-in-time features: only days before the row's own day enter its lags and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import daily_demand

KEYS = ["store_id", "sku"]


def add_lags(daily: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Row lags of 1 and 7 observed days, calendar averages over the 7 and 14 days before.

    All frames order by the whole day number, so one exchange and one sort serve them all and no time
    zone can shift a day.
    """
    day = F.unix_date("feature_date")
    w = Window.partitionBy(*(keys or KEYS)).orderBy(day)
    week, fortnight = w.rangeBetween(-7, -1), w.rangeBetween(-14, -1)
    out = daily.withColumns({
        "units_lag_1d": F.lag("units", 1).over(w), "units_lag_7d": F.lag("units", 7).over(w), "units_avg_7d": F.avg("units").over(week),
        "units_max_7d": F.max("units").over(week), "units_avg_14d": F.avg("units").over(fortnight), "revenue_avg_7d": F.avg("revenue").over(week)})
    return out.withColumn("demand_trend_7d", F.when(F.col("units_avg_14d") > 0, F.col("units_avg_7d") / F.col("units_avg_14d")))


def add_calendar_lag(daily: DataFrame, days: int = 7, keys: list[str] | None = None) -> DataFrame:
    """Units exactly ``days`` calendar days before, null if that day has no row."""
    w = Window.partitionBy(*(keys or KEYS)).orderBy(F.unix_date("feature_date")).rangeBetween(-days, -days)
    return daily.withColumn(f"units_calendar_lag_{days}d", F.max("units").over(w))


def add_calendar(df: DataFrame) -> DataFrame:
    d = F.dayofweek("feature_date")
    return df.withColumns({"day_of_week": d, "is_weekend": d.isin(1, 7), "day_of_month": F.dayofmonth("feature_date")})


def build_features(orders: DataFrame, stamped: bool = True) -> DataFrame:
    out = add_calendar(add_lags(daily_demand(orders)))
    return out.withColumn("_features_built_at", F.current_timestamp()) if stamped else out
