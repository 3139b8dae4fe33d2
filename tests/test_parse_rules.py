from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.parse import parse_topic
from millrace.functions.rules import REASON, add_column_if_missing, future_rule, order_rules, split, stamp_dead_letters, tagged, union_dead_letters, validate_delivery, validate_inventory, validate_orders
from millrace.sources.readers import topic_options, wire_rows
from millrace.sources.schemas import ORDERS, TOPICS

T = datetime(2026, 6, 20, 9)
ORDER = "event_id string, event_time timestamp, store_id string, order_value double, line_count int, status string"


def test_lenient_parse(spark):
    values = ['{"event_id":"a","line_count":2,"is_late":true,"extra":1,"lines":[{"sku":"k","qty":3,"unit_price":1.5}]}', "{bad", None, "", "[]", '{"event_id":"b","line_count":"7"}', '{"order_value":"NaN"}']
    rows = parse_topic(wire_rows(spark, [("s", v) for v in values]), ORDERS).orderBy("_kafka_offset").collect()
    assert len(rows) == len(values) and [r._kafka_offset for r in rows] == list(range(len(values)))
    assert rows[0].event_id == "a" and rows[0].is_late == "true" and rows[0].lines[0].qty == 3 and rows[0]._kafka_key == "s"
    assert all(rows[i].event_id is None for i in (1, 2, 3, 4))
    assert rows[5].event_id == "b" and rows[5].line_count is None
    assert rows[6].order_value != rows[6].order_value
    assert rows[0]._ingest_date is not None


def test_order_reasons(spark):
    rows = [("a", T, "s", 5.0, 1, "placed"), ("b", T, "s", -5.0, 1, "placed"), ("c", T, "s", 999999.0, 1, "placed"), ("d", T, "s", 5.0, 1, "teleported"), ("e", T, "s", 5.0, -1, "placed"),
            (None, T, "s", -5.0, 1, "x"), ("g", None, "s", 5.0, 1, "placed"), ("h", T, None, 5.0, 1, "placed"), ("i", T, "s", None, None, None), ("j", T, "s", 0.0, 0, "placed"),
            ("k", T, "s", 100000.0, 0, "placed"), ("l", T, "s", float("nan"), 0, "placed")]
    df = spark.createDataFrame(rows, ORDER)
    clean, dead = validate_orders(df)
    assert sorted(r.event_id for r in clean.collect()) == ["a", "i", "j", "k"] and REASON not in clean.columns
    got = {r.event_id: r[REASON] for r in dead.collect()}
    assert got == {"b": "order_value_negative", "c": "order_value_implausible", "d": "unknown_status", "e": "negative_line_count", None: "missing_event_id", "g": "missing_event_time",
                   "h": "missing_store_id", "l": "order_value_implausible"}


def test_two_malformed_copies_are_both_refused(spark):
    clean, dead = validate_orders(spark.createDataFrame([("a", T, None, 1.0, 1, "placed")] * 2, ORDER))
    assert clean.count() == 0 and dead.count() == 2


def test_inventory_and_delivery(spark):
    inv = spark.createDataFrame([("a", T, "s", "k", -3), ("b", T, "s", None, 3), ("c", T, "s", "k", None)], "event_id string, event_time timestamp, store_id string, sku string, new_level int")
    assert {r.event_id: r[REASON] for r in validate_inventory(inv)[1].collect()} == {"a": "negative_inventory", "b": "missing_sku"}
    dlv = spark.createDataFrame([("a", T, "o", "teleporting", 1.0), ("b", T, "o", "picked", -1.0), ("c", T, None, "picked", 1.0), ("d", T, "o", None, None)],
                                "event_id string, event_time timestamp, order_id string, stage string, minutes_since_order double")
    assert {r.event_id: r[REASON] for r in validate_delivery(dlv)[1].collect()} == {"a": "unknown_stage", "b": "negative_elapsed", "c": "missing_order_id"}


def test_optional_rule_and_empty(spark):
    own = spark.createDataFrame([("a", datetime(2027, 1, 1), T, "s", 1.0, 1, "placed")], "event_id string, event_time timestamp, ingest_time timestamp, store_id string, order_value double, line_count int, status string")
    assert tagged(own, order_rules() + future_rule()).first()[REASON] == "event_time_implausible"
    assert [x.count() for x in split(own.limit(0), order_rules())] == [0, 0]


def test_additive_column_and_union(spark):
    df = spark.createDataFrame([(1, "x")], "a int, coupon string")
    assert add_column_if_missing(df, "coupon").first().coupon == "x" and add_column_if_missing(df, "new").first().new is None and add_column_if_missing(df).columns == df.columns
    both = union_dead_letters(stamp_dead_letters(df, "orders"), stamp_dead_letters(df.drop("coupon").withColumn("sku", F.lit("k")), "inventory_updates"))
    assert both.count() == 2 and {"coupon", "sku", "_source_topic", "_dead_lettered_at"} <= set(both.columns)


def test_topic_settings():
    o = topic_options("b:1", "orders")
    assert o["maxOffsetsPerTrigger"] == "50000" and o["failOnDataLoss"] == "true" and o["startingOffsets"] == "earliest"
    assert {k: len(v) for k, v in TOPICS.items()} == {"orders": 16, "inventory_updates": 13, "delivery_status": 10}
