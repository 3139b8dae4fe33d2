from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import quality as q
from millrace.operators.aggregates import daily_demand, order_velocity, orders_by_zone_window
from millrace.operators.dedup import dedup_latest, latest_inventory
from millrace.operators.detect import detect_stockouts, first_seen
from millrace.operators.features import add_calendar, add_calendar_lag, build_features

T = datetime(2026, 6, 20, 9)
LINES = "array<struct<sku:string,qty:int,unit_price:double>>"


def at(minute, second=0):
    return T + timedelta(minutes=minute, seconds=second)


def test_dedup_latest(spark):
    rows = [("a", at(0), 1.0), ("a", at(3), 2.0), ("b", None, 3.0), ("b", at(0), 4.0), ("c", at(0), 5.0), ("c", at(0), 6.0)]
    df = spark.createDataFrame(rows, "event_id string, ingest_time timestamp, value double")
    for n in (1, 5):
        assert {r.event_id: r.value for r in dedup_latest(df.repartition(n)).collect()} == {"a": 2.0, "b": 4.0, "c": 6.0}
    assert dedup_latest(df.limit(0)).count() == 0


def test_latest_inventory(spark):
    df = spark.createDataFrame([("s", "k", 100, at(0)), ("s", "k", 80, at(5)), ("s", "k", 90, at(3)), ("s", "j", 1, None)], "store_id string, sku string, new_level int, event_time timestamp")
    assert {(r.sku, r.current_level) for r in latest_inventory(df).collect()} == {("k", 80), ("j", 1)}


def test_zone_windows(spark):
    rows = [("a", at(1), "z", "c", "s1", "u1", 100.0, "placed"), ("b", at(3), "z", "c", "s1", "u2", 200.0, "cancelled"), ("d", at(8), "z", "c", "s2", None, 50.0, None)]
    df = spark.createDataFrame(rows, "event_id string, event_time timestamp, zone string, city string, store_id string, customer_id string, order_value double, status string")
    one, two = orders_by_zone_window(df).orderBy("window_start").collect()
    assert (one.order_count, one.total_value, one.active_stores, one.distinct_customers, one.cancelled_count, one.cancel_rate) == (2, 300.0, 1, 2, 1, 0.5)
    assert (two.order_count, two.distinct_customers, two.cancel_rate) == (1, 0, 0.0) and (one.window_end - one.window_start) == timedelta(minutes=5)


def test_velocity_and_stockouts(spark):
    rows = [("s", at(1), [("k", 4, 1.0), ("j", 1, 1.0)]), ("s", at(2), [("k", 6, 1.0)]), ("s", at(2), []), ("s", at(3), None)]
    v = order_velocity(spark.createDataFrame(rows, f"store_id string, event_time timestamp, lines {LINES}"))
    assert {(r.sku, r.units_ordered, r.order_lines) for r in v.collect()} == {("k", 10, 2), ("j", 1, 1)}


@pytest.mark.parametrize("level, units, minutes", [(10, 40, 1.3), (500, 10, None), (3, 0, None), (0, 20, 0.0), (30, 10, 15.0), (31, 10, None), (0, 0, None), (None, 5, None), (3, None, None), (0, None, 0.0)])
def test_stockout_cases(spark, level, units, minutes):
    inv = spark.createDataFrame([("s", "k", level)], "store_id string, sku string, current_level int")
    vel = spark.createDataFrame([("s", "k", units, 1)], "store_id string, sku string, units_ordered bigint, order_lines bigint")
    got = detect_stockouts(inv, vel).collect()
    assert [r.minutes_to_stockout for r in got] == ([] if minutes is None else [minutes])


def test_stockout_options(spark):
    inv = spark.createDataFrame([("s", "k", 5)], "store_id string, sku string, current_level int")
    vel = spark.createDataFrame([("s", "k", 40, 1, at(0)), ("s", "k", 20, 1, at(5))], "store_id string, sku string, units_ordered bigint, order_lines bigint, window_start timestamp")
    assert detect_stockouts(inv, vel.drop("window_start")).count() == 2
    assert [r.units_ordered for r in detect_stockouts(inv, vel, latest_only=True).collect()] == [20]
    seen = spark.createDataFrame([("s", "k", at(5), 1), ("s", "k", at(1), 2)], "store_id string, sku string, detected_at timestamp, n int")
    assert [r.n for r in first_seen(seen).collect()] == [2]


def orders(spark, days):
    rows = [(str(i), T.replace(day=1) + timedelta(days=d), "s", status, [("k", qty, 2.0)]) for i, (d, qty, status) in enumerate(days)]
    return spark.createDataFrame(rows, f"event_id string, event_time timestamp, store_id string, status string, lines {LINES}")


def test_no_leakage_from_the_day_itself(spark):
    days = [(d, 10, "placed") for d in range(14)]
    got = []
    for qty in (5, 500):
        r = build_features(orders(spark, [*days, (14, qty, "placed")])).where("feature_date = '2026-06-15'").first()
        got.append((r.units_avg_7d, r.units_lag_1d, r.units_max_7d, r.units_avg_14d, r.demand_trend_7d))
    assert got[0] == got[1]


def test_lags_and_calendar(spark):
    f = {str(r.feature_date): r for r in build_features(orders(spark, [(9, 10, "placed"), (10, 20, "placed"), (11, 30, "confirmed"), (11, 99, "cancelled"), (11, 99, None)])).collect()}
    assert f["2026-06-12"].units_avg_7d == 15.0 and f["2026-06-12"].units == 30 and f["2026-06-12"].revenue == 60.0
    assert f["2026-06-10"].units_lag_1d is None and f["2026-06-10"].units_avg_7d is None and f["2026-06-10"].demand_trend_7d is None
    r = add_calendar(spark.sql("select date'2026-06-13' feature_date")).first()
    assert r.is_weekend and r.day_of_week == 7 and r.day_of_month == 13


def test_row_lag_is_not_calendar_lag(spark):
    daily = daily_demand(orders(spark, [(0, 1, "placed"), (7, 2, "placed")]))
    assert {r.units: r.units_calendar_lag_7d for r in add_calendar_lag(daily).collect()} == {1: None, 2: 1}


def test_checks():
    assert q.volume_zscore(130, [90, 90, 110, 110]) == 3.0 and q.volume_zscore(5, [1]) == 0.0 and q.volume_zscore(5, [3, 3]) == 0.0
    assert q.check_volume(130, [90, 90, 110, 110]).severity == "info" and not q.check_volume(131, [90, 90, 110, 110]).passed and not q.check_volume(1, [90, 90, 110, 110]).passed
    assert q.check_freshness(120).passed and not q.check_freshness(121).passed and not q.check_freshness(None).passed
    assert q.check_null_rate(0, 0, "z").passed and not q.check_null_rate(1, 10, "z").passed
    assert q.check_cancel_rate(1.0).passed and not q.check_cancel_rate(1.1).passed and not q.check_no_negative(-1, "n").passed
    ok, bad = q.summarize([q.Result("a", False, "", "warn"), q.Result("b", True, "")])
    assert ok and bad == []


def test_gate(spark):
    rows = [(T - timedelta(days=d) + timedelta(minutes=5 * m), "z", 10 + d % 2, 5.0, 0.1) for d in range(5) for m in range(3)]
    w = spark.createDataFrame(rows, "window_start timestamp, zone string, order_count bigint, total_value double, cancel_rate double").withColumn("window_end", F.expr("window_start + interval 5 minutes"))
    assert len(q.run_gate(w, "2026-06-20", T + timedelta(hours=1), "post")) == 6
    assert q.gold_metrics(w, "2026-06-20", T + timedelta(hours=1))["trailing_counts"] == [33, 30, 33, 30]
    with pytest.raises(q.GateFailed):
        q.run_gate(w, "2026-06-20", T + timedelta(hours=9), "post")
    with pytest.raises(q.GateFailed):
        q.run_gate(w, "2026-07-20", T, "post")
