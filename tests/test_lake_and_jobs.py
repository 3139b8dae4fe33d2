import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.cli import parser, produce
from millrace.operators.dedup import dedup_stream
from millrace.plans.batch import corrected_day, retried, run_backfill, run_daily, run_features
from millrace.plans.lake import Conflict, LakeTable, SchemaChange
from millrace.plans.serving import export, partition_address
from millrace.sources.generator import EventFactory, bulk_orders, iter_events
from millrace.sources.readers import land_topic, read_landed_topic, read_table_stream
from millrace.sources.schemas import ORDERS
from millrace.streaming import jobs

T = datetime(2026, 6, 20, 9)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_evolution(spark, tmp_path):
    t = LakeTable(spark, f"{tmp_path}/t", ("p",))
    a = spark.createDataFrame([(1, "x"), (2, "y y/=")], "a int, p string")
    t.append(a)
    t.append(a.withColumn("n", F.lit("new")), merge_schema=True)
    assert rows(t.read(0)) == rows(a) and t.read().count() == 4 and t.read(where={"p": "y y/="}).count() == 2
    assert rows(t.diff(0, 1)) == [(1, "x", "new"), (2, "y y/=", "new")]
    with pytest.raises(SchemaChange):
        t.append(a.withColumn("m", F.lit(1)))
    with pytest.raises(SchemaChange):
        t.append(a.withColumn("a", F.lit("text")), merge_schema=True)
    assert t.versions() == [0, 1] and t.version_at(t.manifest(0)["time"]) == 0
    t.overwrite_partitions(spark.createDataFrame([(9, "x", None)], "a int, p string, n string"), partitions=[{"p": "y y/="}])
    assert rows(t.read()) == [(9, "x", None)]
    t.compact(["a"], 1)
    assert t.vacuum(1) > 0 and rows(t.read()) == [(9, "x", None)] and len(t.versions()) == 1


def test_commits_are_idempotent_and_exclusive(spark, tmp_path):
    t, df = LakeTable(spark, f"{tmp_path}/t"), spark.range(3)
    assert t.append(df, commit=("q", 0)) == 0 and t.append(df, commit=("q", 0)) is None and t.append(df, commit=("q", 1)) == 1
    assert t.read().count() == 6
    with pytest.raises(Conflict):
        t._publish(t.manifest(0))
    assert t.versions() == [0, 1]


@pytest.mark.parametrize("buckets", [0, 3])
def test_upsert_guard(spark, tmp_path, buckets):
    schema = "k string, v int, as_of int"
    batches = [[("a", 1, 10), ("b", 2, 5)], [("a", 9, 10), ("b", 3, 6), ("c", 4, None)], [("a", 7, None), ("b", 1, 1), ("c", 5, 9), ("b", 8, 6)]]
    t = LakeTable(spark, f"{tmp_path}/t")
    for b in batches:
        t.upsert(spark.createDataFrame(b, schema), ["k"], "as_of", buckets)
    assert rows(t.read().fillna(-1)) == [("a", 1, 10), ("b", 3, 6), ("c", 4, -1)]


def test_retention_and_z_order(spark, tmp_path):
    t = LakeTable(spark, f"{tmp_path}/t", ("d",))
    t.append(spark.sql("select id, date_add(date'2026-06-01', cast(id as int)) d, cast(id % 7 as string) s from range(30)"))
    t.compact(["id", "s"], 3)
    t.drop_older("d", 5, date(2026, 6, 30))
    assert t.read().count() == 6


def orders(spark, data):
    out = [(i, t, n, "s", "z", "c", "u", v, 1, [("k", "n", "g", 2, 1.5)], "placed") for i, t, n, v in data]
    schema = ("event_id string, event_time timestamp, ingest_time timestamp, store_id string, zone string, city string, customer_id string, order_value double, line_count int, "
              "lines array<struct<sku:string,name:string,category:string,qty:int,unit_price:double>>, status string")
    return spark.createDataFrame(out, schema)


def test_backfill_twice_and_daily_run(spark, tmp_path):
    late = T.replace(hour=23, minute=30)
    raw = orders(spark, [("a", T, T, 1.0), ("a", T, T + timedelta(minutes=3), 2.0), ("b", late, late + timedelta(days=2), 3.0), ("c", T + timedelta(days=1), T, 4.0), ("d", T, T, -4.0)])
    assert rows(corrected_day(raw, "2026-06-20").select("event_id", "order_value")) == [("a", 2.0), ("b", 3.0)]
    assert corrected_day(raw, "2026-06-20", topic=None).count() == 3
    silver, gold = LakeTable(spark, f"{tmp_path}/s"), LakeTable(spark, f"{tmp_path}/g")
    for _ in range(2):
        run_backfill(raw, silver, "2026-06-20")
    assert silver.read().count() == 2
    run_daily(spark, raw, silver, gold, "2026-06-20", late + timedelta(hours=1), f"{tmp_path}/serving")
    assert spark.read.parquet(f"{tmp_path}/serving").count() == gold.read().count() == 2
    run_backfill(raw.limit(0), silver, "2026-06-20")
    assert silver.read().count() == 0


def test_feature_build_and_export(spark, tmp_path):
    run_features(orders(spark, [("a", T, T, 1.0), ("b", T - timedelta(days=1), T, 1.0)]), f"{tmp_path}/f")
    run_features(orders(spark, [("a", T, T, 1.0)]), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 2
    df = spark.createDataFrame([(T, "z"), (T - timedelta(days=1), "y")], "window_start timestamp, zone string")
    for _ in range(2):
        export(df, f"{tmp_path}/e", "window_start", ["zone"], "2026-06-20")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 1
    assert partition_address("orders_by_zone_5min", date(2026, 6, 20)) == "orders_by_zone_5min$20260620" and partition_address("t") == "t"


def test_retried():
    calls = []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "done"

    assert retried(step, 2, 0) == "done"
    with pytest.raises(ZeroDivisionError):
        retried(lambda: 1 // 0, 1, 0)


def test_generator():
    f = EventFactory(3, 0.2)
    events = [e for _ in range(600) for e in iter_events(f, T)]
    o = [e for k, e in events if k == "orders"]
    assert len({e["event_id"] for _, e in events}) == len(events)
    assert 0.1 < sum(e["is_late"] for _, e in events) / len(events) < 0.3
    assert all(abs(e["order_value"] - sum(x["qty"] * x["unit_price"] for x in e["lines"])) < 0.01 and 1 <= e["line_count"] <= 6 for e in o)
    assert all(e["delta"] == e["new_level"] - e["previous_level"] and e["new_level"] >= 0 for k, e in events if k == "inventory_updates")
    stages = {}
    for k, e in events:
        if k == "delivery_status":
            stages.setdefault(e["order_id"], []).append(e["stage"])
    assert all(s == ["assigned", "picked", "packed", "dispatched", "delivered"][:len(s)] for s in stages.values())
    assert [e for _ in range(20) for e in iter_events(EventFactory(5), T)] == [e for _ in range(20) for e in iter_events(EventFactory(5), T)]
    rainy = EventFactory(3, rain_surge=True)
    n = [[e for k, e in iter_events(rainy, T) if k == "orders"] for _ in range(200)]
    assert len(rainy.surge_zones) == 2 and all(len(x) == (3 if x[0]["zone"] in rainy.surge_zones else 1) and len({e["zone"] for e in x}) == 1 for x in n)


def test_bulk_orders_and_cli(spark, tmp_path):
    df = bulk_orders(spark, 500)
    assert df.schema.names == ORDERS.names and df.count() == 500 and rows(df.select("event_id", "order_value")) == rows(bulk_orders(spark, 500).select("event_id", "order_value"))
    a = parser().parse_args(["produce", "--out", f"{tmp_path}/o", "--duration", "0.3", "--rain-surge"])
    counts = produce(a)
    lines = [json.loads(x) for x in open(a.out)]
    assert len(lines) == sum(counts.values()) and all(x["key"] == x["value"]["store_id"] for x in lines)
    assert parser().parse_args(["backfill", "--raw-path", "r", "--silver-path", "s", "--process-date", "2026-06-20"]).process_date == "2026-06-20"
    with pytest.raises(SystemExit):
        parser().parse_args(["backfill", "--raw-path", "r"])


def test_streams_end_to_end_with_restart(spark, tmp_path):
    base, state, land = f"{tmp_path}/lake", f"{tmp_path}/state", f"{tmp_path}/land"
    first = bulk_orders(spark, 300, start="2026-06-20 09:00:00", late_fraction=0.0)
    land_topic(first.union(first.limit(20)).union(first.limit(5).withColumn("order_value", F.lit(-1.0))), land)

    def bronze_and_silver():
        jobs.start_bronze(read_landed_topic(spark, land), "orders", base, state, once=True).awaitTermination()
        for q in jobs.start_silver(jobs.bronze_table(spark, base, "orders").stream(), "orders", base, state, once=True):
            q.awaitTermination()

    bronze_and_silver()
    silver = jobs.silver_table(spark, base, "orders")
    assert jobs.bronze_table(spark, base, "orders").read().count() == 325 and silver.read().count() == 300
    dead = LakeTable(spark, f"{base}/dead_letter").read()
    assert dead.count() == 5 and dead.first()._source_topic == "orders"
    land_topic(bulk_orders(spark, 50, seed=8, start="2026-06-20 10:00:00").withColumn("event_id", F.concat(F.lit("n"), "event_id")), land)
    bronze_and_silver()
    assert silver.read().count() == 350
    jobs.start_zone_windows(silver.stream(), base, state, once=True).awaitTermination()
    gold = LakeTable(spark, f"{base}/gold_orders_by_zone_5min").read()
    assert gold.agg(F.sum("order_count")).first()[0] >= 290


def test_late_rows_and_bounded_dedup(spark, tmp_path):
    """Lateness is judged by the watermark of the batch before: three batches and more are needed to see it."""
    schema = spark.createDataFrame([], "event_id string, event_time timestamp").schema
    (tmp_path / "in").mkdir()

    def run(*data):
        spark.createDataFrame(list(data), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = (dedup_stream(read_table_stream(spark, f"{tmp_path}/in", schema)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
             .trigger(availableNow=True).start(f"{tmp_path}/out"))
        q.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run(("a", T)) == 1
    assert run(("a", T + timedelta(minutes=2)), ("b", T + timedelta(minutes=30))) == 2
    assert run(("c", T + timedelta(minutes=31))) == 3
    assert run(("late", T + timedelta(minutes=1)), ("d", T + timedelta(minutes=32))) == 4


def test_inventory_stream_and_detector(spark, tmp_path):
    base, state, src = f"{tmp_path}/lake", f"{tmp_path}/state", f"{tmp_path}/in"
    schema = "store_id string, sku string, new_level int, event_time timestamp"
    for level, minute in ((100, 0), (8, 5), (90, 3)):
        spark.createDataFrame([("s", "k", level, T + timedelta(minutes=minute))], schema).write.mode("append").parquet(src)
        updates = read_table_stream(spark, src, spark.createDataFrame([], schema).schema)
        jobs.start_inventory(updates, base, state, once=True).awaitTermination()
    assert [r.current_level for r in LakeTable(spark, f"{base}/gold_store_sku_inventory").read().collect()] == [8]
    v = spark.createDataFrame([("s", "k", 40, 1, T)], "store_id string, sku string, units_ordered bigint, order_lines bigint, window_start timestamp")
    jobs.run_detector(spark, base, v)
    assert LakeTable(spark, f"{base}/stockout_alerts").read().count() == 1


def test_upsert_keeps_the_tables_buckets(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    rows = lambda n, v: spark.range(n).selectExpr("id as k", f"{v} as v")
    t.upsert(rows(50, 1), ["k"], "v", buckets=16)
    t.upsert(rows(30, 2), ["k"], "v", buckets=4)
    got = {r.k: r.v for r in LakeTable(spark, t.path).read().collect()}
    assert LakeTable(spark, t.path).read().count() == 50 and got == {k: 2 if k < 30 else 1 for k in range(50)}


def test_manifests_are_whole_and_failed_commits_leave_nothing(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    t.append(spark.range(3).toDF("a"))
    with pytest.raises(Conflict):
        t._publish(t.manifest())
    assert t.versions() == [0] and not list((tmp_path / "t" / "_log").glob("*.tmp"))
    before = sorted((tmp_path / "t" / "data").rglob("*.parquet"))
    t._commit_files, failing = None, t._write(spark.range(2).toDF("a"), "data")
    with pytest.raises(TypeError):
        t._commit(failing, spark.range(1).toDF("a").schema, False, "append")
    assert sorted((tmp_path / "t" / "data").rglob("*.parquet")) == before


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        t = LakeTable(spark, str(tmp_path / "t"), ("day",))
        t.append(spark.range(400_000).selectExpr("id", "uuid() as x", "date'2024-01-01' as day"))
        assert len(t.manifest()["files"]) > 1 and t.read().count() == 400_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
