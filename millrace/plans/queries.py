"""Registered queries over the test tables, and DuckDB SQL for the same results.

The test tables stand in for the event topics: ``events`` are order events of their user and type;
``orders`` with their lines are orders of a nation and region; ``lineitem`` repeats its keys.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.parse import parse_topic
from millrace.functions.rules import REASON, add_column_if_missing, delivery_rules, inventory_rules, order_rules, split, tagged, union_dead_letters
from millrace.operators import quality
from millrace.operators.aggregates import daily_demand, order_velocity, orders_by_zone_window
from millrace.operators.dedup import dedup_latest, dedup_stream, latest_inventory
from millrace.operators.detect import detect_stockouts, first_seen
from millrace.operators.features import add_calendar, add_calendar_lag, add_lags
from millrace.plans.batch import corrected_day, event_day
from millrace.plans.lake import LakeTable, z_value
from millrace.plans.serving import partition_address
from millrace.sources.generator import bulk_orders
from millrace.sources.readers import table, with_instants
from millrace.sources.schemas import struct

DAY = "2024-01-30"
NOW = datetime(2024, 1, 31)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, or in a local one where none is set."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        home = tempfile.mkdtemp(prefix="millrace-")
    return f"{home}/millrace-{uuid.uuid4().hex}"


# the tables as event topics


def event_orders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("event_time"), F.col("ts").alias("ingest_time"),
                    F.col("user_id").cast("string").alias("store_id"), (F.col("event_id") % 97).cast("string").alias("customer_id"),
                    F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("city"), F.col("event_type").alias("zone"), F.col("value").alias("order_value"),
                    F.when(F.col("event_type") == "error", "cancelled").otherwise("placed").alias("status"))


EVENT_ORDERS = """eo AS (SELECT event_id::VARCHAR event_id, ts event_time, ts ingest_time, user_id::VARCHAR store_id, (event_id % 97)::VARCHAR customer_id,
 'c' || (user_id % 3)::VARCHAR city, event_type zone, value order_value, CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'placed' END status, user_id, event_type FROM events)"""


def faulty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with faults of every kind planted by key."""
    k = F.col("o_orderkey")
    some = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
    status = F.when(F.col("o_orderstatus") == "O", "placed").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("cancelled")
    none = F.lit(None)
    return table(spark, d, "orders").select(
        some(97, none, k.cast("string")).alias("event_id"), some(89, none, F.col("o_orderdate")).alias("event_time"), some(83, none, F.col("o_custkey").cast("string")).alias("store_id"),
        some(19, -F.col("o_totalprice"), F.col("o_totalprice")).alias("order_value"), some(71, F.lit("teleported"), some(73, none, status)).alias("status"),
        some(61, F.lit(-1), F.lit(1)).alias("line_count"), k.alias("order_key"))


FAULTY_ORDERS = """fo AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey::VARCHAR END event_id, CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_orderdate END event_time,
 CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_custkey::VARCHAR END store_id, CASE WHEN o_orderkey % 19 = 0 THEN -o_totalprice ELSE o_totalprice END order_value,
 CASE WHEN o_orderkey % 71 = 0 THEN 'teleported' WHEN o_orderkey % 73 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'placed' WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'cancelled' END status,
 CASE WHEN o_orderkey % 61 = 0 THEN -1 ELSE 1 END line_count, o_orderkey order_key FROM orders),
 fr AS (SELECT *, CASE WHEN event_id IS NULL THEN 'missing_event_id' WHEN event_time IS NULL THEN 'missing_event_time' WHEN store_id IS NULL THEN 'missing_store_id'
 WHEN order_value < 0 THEN 'order_value_negative' WHEN order_value > 100000 THEN 'order_value_implausible' WHEN status NOT IN ('placed', 'confirmed', 'cancelled') THEN 'unknown_status'
 WHEN line_count < 0 THEN 'negative_line_count' END reason FROM fo)"""


def faulty_inventory(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    some = lambda m, bad, good: F.when(k % m == 0, bad).otherwise(good)
    none = F.lit(None)
    return table(spark, d, "events").select(k.cast("string").alias("event_id"), some(13, none, F.col("ts")).alias("event_time"), some(17, none, F.col("user_id").cast("string")).alias("store_id"),
                                            some(11, none, F.col("event_type")).alias("sku"), (F.floor("value").cast("int") - 20).alias("new_level"))


FAULTY_INVENTORY = """fi AS (SELECT event_id::VARCHAR event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END event_time, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id::VARCHAR END store_id,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END sku, floor(value)::INTEGER - 20 new_level FROM events),
 ir AS (SELECT *, CASE WHEN event_id IS NULL THEN 'missing_event_id' WHEN event_time IS NULL THEN 'missing_event_time' WHEN store_id IS NULL THEN 'missing_store_id'
 WHEN sku IS NULL THEN 'missing_sku' WHEN new_level < 0 THEN 'negative_inventory' END reason FROM fi)"""


def faulty_delivery(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    stage = F.when(F.col("event_type") == "error", "teleporting").otherwise("packed")
    return table(spark, d, "events").select(k.cast("string").alias("event_id"), F.col("ts").alias("event_time"), F.when(k % 23 != 0, k.cast("string")).alias("order_id"),
                                            stage.alias("stage"), (F.col("value") - 30).alias("minutes_since_order"))


FAULTY_DELIVERY = """fd AS (SELECT event_id::VARCHAR event_id, ts event_time, CASE WHEN event_id % 23 <> 0 THEN event_id::VARCHAR END order_id,
 CASE WHEN event_type = 'error' THEN 'teleporting' ELSE 'packed' END stage, value - 30 minutes_since_order FROM events),
 dr AS (SELECT *, CASE WHEN event_id IS NULL THEN 'missing_event_id' WHEN event_time IS NULL THEN 'missing_event_time' WHEN order_id IS NULL THEN 'missing_order_id'
 WHEN stage NOT IN ('assigned', 'picked', 'packed', 'dispatched', 'delivered') THEN 'unknown_stage' WHEN minutes_since_order < 0 THEN 'negative_elapsed' END reason FROM fd)"""


def order_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a region (store) with their lines (brand as sku)."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("p_brand").alias("sku"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").alias("unit_price"))).alias("lines"))
    status = F.when(F.col("o_orderstatus") == "O", "placed").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("cancelled")
    return (table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").alias("event_time"), F.col("r_name").alias("store_id"), status.alias("status"), "lines"))


DEMAND = """dd AS (SELECT o_orderdate::DATE feature_date, r_name store_id, p_brand sku, sum(l_quantity::INTEGER)::BIGINT units, count(*) order_lines, sum(l_quantity::INTEGER * l_extendedprice) revenue
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON o_orderkey = l_orderkey
 JOIN part ON l_partkey = p_partkey WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL)"""
LAGS = """lg AS (SELECT *, lag(units, 1) OVER w units_lag_1d, lag(units, 7) OVER w units_lag_7d, avg(units) OVER w7 units_avg_7d, max(units) OVER w7 units_max_7d,
 avg(units) OVER w14 units_avg_14d, avg(revenue) OVER w7 revenue_avg_7d FROM dd WINDOW w AS (PARTITION BY store_id, sku ORDER BY feature_date),
 w7 AS (PARTITION BY store_id, sku ORDER BY feature_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING),
 w14 AS (PARTITION BY store_id, sku ORDER BY feature_date RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))"""
LAG_COLUMNS = """units_lag_1d, units_lag_7d, round(units_avg_7d, 6) units_avg_7d, units_max_7d, round(units_avg_14d, 6) units_avg_14d, round(revenue_avg_7d, 6) revenue_avg_7d,
 round(CASE WHEN units_avg_14d > 0 THEN units_avg_7d / units_avg_14d END, 6) demand_trend_7d"""
CALENDAR = "dayofweek(feature_date)::INTEGER + 1 day_of_week, dayofweek(feature_date) IN (0, 6) is_weekend, day(feature_date)::INTEGER day_of_month"
ZONES = """zw AS (SELECT time_bucket(INTERVAL 5 MINUTES, event_time) window_start, time_bucket(INTERVAL 5 MINUTES, event_time) + INTERVAL 5 MINUTES window_end, zone, city, count(*) order_count,
 sum(order_value) total_value, avg(order_value) avg_order_value, count(DISTINCT store_id) active_stores, count(DISTINCT customer_id) distinct_customers,
 sum(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END)::BIGINT cancelled_count, round(sum(CASE WHEN status = 'cancelled' THEN 1 ELSE 0 END) / count(*), 4) cancel_rate FROM eo GROUP BY ALL)"""
ZONE_COLUMNS = "window_start, window_end, zone, city, order_count, round(total_value, 4) total_value, round(avg_order_value, 4) avg_order_value, active_stores, distinct_customers, cancelled_count, cancel_rate"


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def zone_windows(spark: SparkSession, d: str) -> DataFrame:
    return orders_by_zone_window(event_orders(spark, d))


def zone_window_5min(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zone_windows(spark, d), {"total_value": 4, "avg_order_value": 4})


def parse_props(spark: SparkSession, d: str) -> DataFrame:
    """The props column as the values of a topic."""
    e = table(spark, d, "events")
    wire = e.select(F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), F.lit(0).alias("partition"),
                    F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))
    return parse_topic(wire, struct("k int"), dated=False).drop("_ingested_at", "_kafka_partition")


def validate_split_counts(spark: SparkSession, d: str) -> DataFrame:
    clean, dead = split(faulty_orders(spark, d), order_rules())
    return clean.groupBy().agg(F.lit("clean").alias("reason"), F.count(F.lit(1)).alias("n")).union(dead.groupBy(REASON).count())


def dead_letter_rows(spark: SparkSession, d: str) -> DataFrame:
    return split(faulty_orders(spark, d), order_rules())[1].select("order_key", "status", "line_count", F.col(REASON).alias("reason"))


def validate_inventory(spark: SparkSession, d: str) -> DataFrame:
    return tagged(faulty_inventory(spark, d), inventory_rules()).groupBy(F.col(REASON).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validate_delivery(spark: SparkSession, d: str) -> DataFrame:
    return tagged(faulty_delivery(spark, d), delivery_rules()).groupBy(F.col(REASON).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dead_letter_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [split(f(spark, d), r())[1].withColumn("_source_topic", F.lit(t)) for f, r, t in (
        (faulty_orders, order_rules, "orders"), (faulty_inventory, inventory_rules, "inventory_updates"), (faulty_delivery, delivery_rules, "delivery_status"))]
    out = union_dead_letters(*parts)
    return out.select("event_id", "event_time", "store_id", "sku", "order_id", "stage", F.col(REASON).alias("reason"), F.col("_source_topic").alias("source_topic"))


TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dedup_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return dedup_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", TIES)


def event_date_slice(spark: SparkSession, d: str) -> DataFrame:
    return event_day(event_orders(spark, d), DAY).select("event_id", "event_time", "store_id", "event_date")


def twice(spark: SparkSession, d: str) -> DataFrame:
    """Events with a second, later copy of every third one."""
    own = event_orders(spark, d).withColumn("line_count", F.lit(1))
    again = own.where("cast(event_id as bigint) % 3 = 0").withColumns({"ingest_time": F.expr("ingest_time + interval 2 days"), "order_value": F.col("order_value") + 1})
    return own.union(again)


def backfill_day(spark: SparkSession, d: str) -> DataFrame:
    return corrected_day(twice(spark, d), "2024-01-15", ties=["order_value"]).select("event_id", "event_time", "ingest_time", "order_value", "event_date")


def events_with_lines(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    return table(spark, d, "events").select(F.col("ts").alias("event_time"), F.col("user_id").cast("string").alias("store_id"), F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("sku"), i.alias("qty"))).alias("lines"))


VELOCITY = """vl AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) window_start, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES window_end, user_id::VARCHAR store_id, 'k' || i::VARCHAR sku,
 sum(i)::BIGINT units_ordered, count(*) order_lines FROM (SELECT ts, user_id, unnest(range(1, event_id % 4 + 1)) i FROM events) GROUP BY ALL)"""


def velocity_5min(spark: SparkSession, d: str) -> DataFrame:
    return order_velocity(events_with_lines(spark, d))


def inventory_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("store_id"), F.concat(F.lit("k"), (1 + F.col("event_id") % 3).cast("string")).alias("sku"),
                                            F.floor(F.col("value") / 4).cast("int").alias("new_level"), F.col("ts").alias("event_time"))


LATEST = """lv AS (SELECT store_id, sku, arg_max(new_level, (event_time, new_level)) current_level, max(event_time) as_of FROM (SELECT user_id::VARCHAR store_id,
 'k' || (1 + event_id % 3)::VARCHAR sku, floor(value / 4)::INTEGER new_level, ts event_time FROM events) GROUP BY ALL)"""
ALERTS = """al AS (SELECT store_id, sku, current_level, units_ordered, demand_per_minute, round(m, 1) minutes_to_stockout, 15 horizon_minutes, window_start FROM (
 SELECT *, CASE WHEN demand_per_minute <= 0 THEN NULL WHEN current_level <= 0 THEN 0.0 ELSE current_level / demand_per_minute END m FROM (
 SELECT lv.*, vl.units_ordered, vl.window_start, units_ordered / 5.0::DOUBLE demand_per_minute FROM lv JOIN vl USING (store_id, sku))) WHERE m <= 15)"""


def latest_levels(spark: SparkSession, d: str) -> DataFrame:
    return latest_inventory(inventory_events(spark, d))


def inventory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the newer one first and both replayed, through the table's upsert."""
    e, lake = inventory_events(spark, d), LakeTable(spark, scratch(spark))
    for k, cond in enumerate(("event_time >= timestamp_ntz'2024-01-15'", "event_time < timestamp_ntz'2024-01-15'", "event_time >= timestamp_ntz'2024-01-15'")):
        lake.upsert(latest_inventory(e.where(cond)), ["store_id", "sku"], "as_of", buckets=4, commit=("q", k))
    return lake.read().select("store_id", "sku", "current_level", "as_of")


def alerts(spark: SparkSession, d: str, stamped: bool = False) -> DataFrame:
    return detect_stockouts(latest_levels(spark, d).drop("as_of"), velocity_5min(spark, d), stamped=stamped)


def stockout_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts(spark, d)


def timed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts that carry their window's start as the time of detection."""
    v = velocity_5min(spark, d)
    own = detect_stockouts(latest_levels(spark, d).drop("as_of"), v, stamped=False).dropDuplicates()
    return own.join(v.select("store_id", "sku", "units_ordered", F.col("window_start").alias("detected_at")), ["store_id", "sku", "units_ordered"])


def first_seen_alert(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(timed_alerts(spark, d)).select("store_id", "sku", "detected_at", "units_ordered", "current_level")


def top_alerts(spark: SparkSession, d: str) -> DataFrame:
    own = timed_alerts(spark, d).where("detected_at >= timestamp_ntz'2024-01-20' and detected_at < timestamp_ntz'2024-01-21'")
    return own.orderBy("minutes_to_stockout", "store_id", "sku", "detected_at").limit(25).select("store_id", "sku", "detected_at", "minutes_to_stockout")


def top_windows(spark: SparkSession, d: str) -> DataFrame:
    own = zone_windows(spark, d).where(f"window_start >= timestamp_ntz'{DAY}' - interval 1 day and window_start < timestamp_ntz'{DAY}'")
    return own.orderBy(F.desc("order_count"), "window_start", "zone", "city").limit(20).select("window_start", "zone", "city", "order_count")


def rows_per_day(spark: SparkSession, d: str) -> DataFrame:
    return event_orders(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(7)


def daily_demand_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(daily_demand(order_events(spark, d)), {"revenue": 2})


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(add_lags(daily_demand(order_events(spark, d))), {"units_avg_7d": 6, "units_avg_14d": 6, "revenue_avg_7d": 6, "demand_trend_7d": 6})
    return out.drop("order_lines", "revenue")


def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    return add_calendar(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("feature_date")).distinct())


def calendar_lag(spark: SparkSession, d: str) -> DataFrame:
    return add_calendar_lag(daily_demand(order_events(spark, d))).select("feature_date", "store_id", "sku", "units", "units_calendar_lag_7d")


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(add_calendar(add_lags(daily_demand(order_events(spark, d)))), {"revenue": 2, "units_avg_7d": 6, "units_avg_14d": 6, "revenue_avg_7d": 6, "demand_trend_7d": 6})


def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.day_metrics(zone_windows(spark, d), DAY), {"min_total_value": 4})


def trailing_14(spark: SparkSession, d: str) -> DataFrame:
    return quality.trailing_days(zone_windows(spark, d), DAY)


def volume_zscore(spark: SparkSession, d: str) -> DataFrame:
    """The z-score by aggregation, as the driver-side check computes it."""
    own = zone_windows(spark, d)
    past = quality.trailing_days(own, DAY).agg(F.avg("order_count").alias("m"), F.stddev_pop("order_count").alias("s"), F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    now = quality.day_metrics(own, DAY).select("today_count", F.lit(1).alias("one"))
    z = F.when((F.col("n") < 2) | (F.col("s") == 0), F.lit(0.0)).otherwise((F.col("today_count") - F.col("m")) / F.col("s"))
    return now.join(past, "one").select("today_count", F.round(z, 6).alias("z"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    results = quality.suite(quality.gold_metrics(zone_windows(spark, d), DAY, NOW))
    return spark.createDataFrame([(i, r.check, r.passed, r.severity) for i, r in enumerate(results)], "pos long, check string, passed boolean, severity string")


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the second version of a table has and the first lacks."""
    lake, n = LakeTable(spark, scratch(spark), ("n_regionkey",)), table(spark, d, "nation")
    lake.append(n.where("n_regionkey < 4"))
    lake.append(n.where("n_regionkey >= 3"))
    return lake.diff(0, 1)


def additive_column(spark: SparkSession, d: str) -> DataFrame:
    return add_column_if_missing(add_column_if_missing(table(spark, d, "nation"), "coupon"), "n_name")


def table_evolution(spark: SparkSession, d: str) -> DataFrame:
    """An append that adds a column, an overwrite of one partition, a compaction."""
    lake, c = LakeTable(spark, scratch(spark), ("c_mktsegment",)), table(spark, d, "customer")
    lake.append(c)
    lake.append(c.where("c_custkey % 10 = 0").withColumn("coupon", F.lit("x")), merge_schema=True)
    lake.overwrite_partitions(c.where("c_mktsegment = 'BUILDING' and c_custkey % 2 = 0").withColumn("coupon", F.lit("y")))
    lake.compact(["c_nationkey", "c_acctbal"], 4)
    return lake.read().groupBy("c_mktsegment", "coupon").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """Z-values of a fixed grid: eight quantile ranks of each column, bits in turn."""
    own = table(spark, d, "region")
    return own.select("r_regionkey", z_value(own, ["r_regionkey"], 2).alias("z"))


def serving_address(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(partition_address("orders_by_zone_5min", DAY),), (partition_address("orders_by_zone_5min"),)], "address string")


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    own = event_orders(spark, d)
    return own.where(f"event_time >= timestamp_ntz'{DAY} 12:00:00' - interval 60 minutes and event_time < timestamp_ntz'{DAY} 12:00:00'").select("event_id", "event_time")


def generated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a seeded load of orders, by status."""
    own = bulk_orders(spark, 20_000)
    return own.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("line_count").alias("lines"), F.sum(F.col("is_late").cast("boolean").cast("int")).alias("late"))


def _streamed(spark: SparkSession, df: DataFrame, run) -> DataFrame:
    """Land ``df`` in three files in time order, stream them one a batch through ``run``, return what it wrote."""
    home = scratch(spark)
    for k in range(3):
        (df.where(F.pmod(F.dayofmonth("event_time") - 1, F.lit(31)).between(k * 11, k * 11 + 10)).coalesce(1).write.mode("append").parquet(f"{home}/in"))
    own = with_instants(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in"))
    return run(own, home)


def _sink(out: DataFrame, home: str) -> DataFrame:
    q = out.writeStream.option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{home}/out")
    q.awaitTermination()
    return out.sparkSession.read.parquet(f"{home}/out")


def stream_zone_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows that a stream of the events emits: all but those the watermark has not passed."""
    out = _streamed(spark, event_orders(spark, d), lambda s, home: _sink(orders_by_zone_window(s), home))
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "zone", "city", "order_count", "active_stores", "distinct_customers", "cancelled_count", "cancel_rate")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events of a stream in which every third one comes twice."""
    own = event_orders(spark, d).select("event_id", "event_time")
    out = _streamed(spark, own.union(own.where("cast(event_id as bigint) % 3 = 0")), lambda s, home: _sink(dedup_stream(s), home))
    return out.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Current levels kept by micro-batch upserts."""
    from millrace.streaming.jobs import upsert_inventory

    def run(s: DataFrame, home: str) -> DataFrame:
        lake = LakeTable(spark, f"{home}/levels")
        s.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(upsert_inventory(lake, 4)).start().awaitTermination()
        return lake.read()

    out = _streamed(spark, inventory_events(spark, d), run)
    return out.select("store_id", "sku", "current_level", F.col("as_of").cast("timestamp_ntz").alias("as_of"))


QUERIES = {
    "parse_props": parse_props, "validate_split_counts": validate_split_counts, "dead_letter_rows": dead_letter_rows, "validate_inventory": validate_inventory,
    "validate_delivery": validate_delivery, "dead_letter_union": dead_letter_union, "dedup_latest": dedup_lineitem, "event_date_slice": event_date_slice,
    "backfill_day": backfill_day, "zone_window_5min": zone_window_5min, "velocity_5min": velocity_5min, "latest_inventory": latest_levels, "inventory_upsert": inventory_upsert,
    "stockout_alerts": stockout_alerts, "first_seen_alert": first_seen_alert, "top_alerts": top_alerts, "top_windows": top_windows, "rows_per_day": rows_per_day,
    "daily_demand": daily_demand_query, "lag_features": lag_features, "calendar_features": calendar_features, "calendar_lag": calendar_lag, "feature_table": feature_table,
    "daily_metrics": daily_metrics, "trailing_14": trailing_14, "volume_zscore": volume_zscore, "quality_report": quality_report, "version_diff": version_diff,
    "additive_column": additive_column, "table_evolution": table_evolution, "clustered": clustered, "serving_address": serving_address, "recent_events": recent_events,
    "generated_orders": generated_orders, "stream_zone_window": stream_zone_window, "stream_dedup": stream_dedup, "stream_upsert": stream_upsert,
}

ORACLE_SQL = {
    "parse_props": "SELECT (props->>'k')::INTEGER k, event_id::VARCHAR _kafka_key, event_id _kafka_offset, ts _kafka_timestamp FROM events",
    "validate_split_counts": f"WITH {FAULTY_ORDERS} SELECT coalesce(reason, 'clean') reason, count(*) n FROM fr GROUP BY ALL",
    "dead_letter_rows": f"WITH {FAULTY_ORDERS} SELECT order_key, status, line_count, reason FROM fr WHERE reason IS NOT NULL",
    "validate_inventory": f"WITH {FAULTY_INVENTORY} SELECT reason, count(*) n FROM ir GROUP BY ALL",
    "validate_delivery": f"WITH {FAULTY_DELIVERY} SELECT reason, count(*) n FROM dr GROUP BY ALL",
    "dead_letter_union": f"""WITH {FAULTY_ORDERS}, {FAULTY_INVENTORY}, {FAULTY_DELIVERY}
 SELECT event_id, event_time, store_id, NULL::VARCHAR sku, NULL::VARCHAR order_id, NULL::VARCHAR stage, reason, 'orders' source_topic FROM fr WHERE reason IS NOT NULL
 UNION ALL SELECT event_id, event_time, store_id, sku, NULL, NULL, reason, 'inventory_updates' FROM ir WHERE reason IS NOT NULL
 UNION ALL SELECT event_id, event_time, NULL, NULL, order_id, stage, reason, 'delivery_status' FROM dr WHERE reason IS NOT NULL""",
    "dedup_latest": "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, "
                    + ", ".join(f"{c} DESC NULLS LAST" for c in TIES) + ") = 1",
    "event_date_slice": f"SELECT event_id::VARCHAR event_id, ts event_time, user_id::VARCHAR store_id, ts::DATE event_date FROM events WHERE ts::DATE = DATE '{DAY}'",
    "backfill_day": """SELECT event_id::VARCHAR event_id, ts event_time, ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 2 DAYS ELSE INTERVAL 0 DAYS END ingest_time,
 value + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END order_value, ts::DATE event_date FROM events WHERE ts::DATE = DATE '2024-01-15'
 AND NOT value < 0 AND NOT value > 100000""",
    "zone_window_5min": f"WITH {EVENT_ORDERS}, {ZONES} SELECT {ZONE_COLUMNS} FROM zw",
    "velocity_5min": f"WITH {VELOCITY} SELECT * FROM vl",
    "latest_inventory": f"WITH {LATEST} SELECT * FROM lv",
    "inventory_upsert": f"WITH {LATEST} SELECT * FROM lv",
    "stockout_alerts": f"WITH {LATEST}, {VELOCITY}, {ALERTS} SELECT * EXCLUDE (window_start) FROM al",
    "first_seen_alert": f"""WITH {LATEST}, {VELOCITY}, {ALERTS} SELECT store_id, sku, window_start detected_at, units_ordered, current_level FROM al
 QUALIFY row_number() OVER (PARTITION BY store_id, sku ORDER BY window_start) = 1""",
    "top_alerts": f"""WITH {LATEST}, {VELOCITY}, {ALERTS} SELECT store_id, sku, window_start detected_at, minutes_to_stockout FROM al
 WHERE window_start >= TIMESTAMP '2024-01-20' AND window_start < TIMESTAMP '2024-01-21' ORDER BY minutes_to_stockout, store_id, sku, window_start LIMIT 25""",
    "top_windows": f"""WITH {EVENT_ORDERS}, {ZONES} SELECT window_start, zone, city, order_count FROM zw WHERE window_start >= TIMESTAMP '{DAY}' - INTERVAL 1 DAY
 AND window_start < TIMESTAMP '{DAY}' ORDER BY order_count DESC, window_start, zone, city LIMIT 20""",
    "rows_per_day": "SELECT ts::DATE AS day, count(*) n FROM events GROUP BY ALL ORDER BY day DESC LIMIT 7",
    "daily_demand": f"WITH {DEMAND} SELECT * REPLACE (round(revenue, 2) AS revenue) FROM dd",
    "lag_features": f"WITH {DEMAND}, {LAGS} SELECT feature_date, store_id, sku, units, {LAG_COLUMNS} FROM lg",
    "calendar_features": f"SELECT feature_date, {CALENDAR} FROM (SELECT DISTINCT o_orderdate::DATE feature_date FROM orders)",
    "calendar_lag": f"""WITH {DEMAND} SELECT a.feature_date, a.store_id, a.sku, a.units, b.units units_calendar_lag_7d FROM dd a LEFT JOIN dd b
 ON a.store_id = b.store_id AND a.sku = b.sku AND b.feature_date = a.feature_date - 7""",
    "feature_table": f"WITH {DEMAND}, {LAGS} SELECT feature_date, store_id, sku, units, order_lines, round(revenue, 2) revenue, {LAG_COLUMNS}, {CALENDAR} FROM lg",
    "daily_metrics": f"""WITH {EVENT_ORDERS}, {ZONES} SELECT sum(order_count)::BIGINT today_count, min(order_count) min_order_count, round(min(total_value), 4) min_total_value,
 count(*) FILTER (zone IS NULL) null_zone_count, max(cancel_rate) max_cancel_rate, max(window_end) latest_end, count(*) row_count FROM zw WHERE window_start::DATE = DATE '{DAY}'""",
    "trailing_14": f"SELECT ts::DATE AS day, count(*) order_count FROM events WHERE ts::DATE < DATE '{DAY}' GROUP BY ALL ORDER BY day DESC LIMIT 14",
    "volume_zscore": f"""WITH p AS (SELECT ts::DATE AS day, count(*) n FROM events WHERE ts::DATE < DATE '{DAY}' GROUP BY ALL ORDER BY day DESC LIMIT 14),
 t AS (SELECT count(*) today_count FROM events WHERE ts::DATE = DATE '{DAY}') SELECT today_count, round(CASE WHEN (SELECT count(*) FROM p) < 2 OR (SELECT stddev_pop(n) FROM p) = 0 THEN 0
 ELSE (today_count - (SELECT avg(n) FROM p)) / (SELECT stddev_pop(n) FROM p) END, 6) z FROM t""",
    "version_diff": "SELECT * FROM nation WHERE n_regionkey >= 3",
    "additive_column": "SELECT *, NULL::VARCHAR coupon FROM nation",
    "table_evolution": """WITH x AS (SELECT c_mktsegment, NULL coupon, c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL
 SELECT c_mktsegment, 'x', c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 10 = 0 UNION ALL
 SELECT c_mktsegment, 'y', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0) SELECT c_mktsegment, coupon, count(*) n, sum(c_custkey)::BIGINT AS keys FROM x GROUP BY ALL""",
    "serving_address": "SELECT unnest(['orders_by_zone_5min$20240130', 'orders_by_zone_5min']) address",
    "recent_events": f"SELECT event_id::VARCHAR event_id, ts event_time FROM events WHERE ts >= TIMESTAMP '{DAY} 12:00:00' - INTERVAL 60 MINUTES AND ts < TIMESTAMP '{DAY} 12:00:00'",
    "stream_zone_window": f"""WITH {EVENT_ORDERS}, {ZONES} SELECT window_start, window_end, zone, city, order_count, active_stores, distinct_customers, cancelled_count, cancel_rate FROM zw
 WHERE window_end <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
    "stream_dedup": "SELECT event_id::VARCHAR event_id, ts event_time FROM events",
    "stream_upsert": f"WITH {LATEST} SELECT * FROM lv",
}
