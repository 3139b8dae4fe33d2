"""Declared schemas of the event topics and their enumerations. All fields are nullable."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def struct(fields: str, **more: T.DataType) -> T.StructType:
    """A struct from ``name kind, name kind``; ``more`` gives kinds that are not primitive. Needs no session."""
    kinds = KINDS | more
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in (f.split() for f in fields.split(","))])


LINES = T.ArrayType(struct("sku string, name string, category string, qty int, unit_price double"))
HEAD = "event_id string, event_type string"
TIMES = "event_time timestamp, ingest_time timestamp, is_late string"

ORDERS = struct(f"{HEAD}, order_id string, {TIMES}, store_id string, city string, zone string, customer_id string, order_value double, "
                "line_count int, lines lines, payment_method string, status string, promised_minutes int", lines=LINES)
INVENTORY = struct(f"{HEAD}, {TIMES}, store_id string, sku string, sku_name string, category string, "
                   "previous_level int, new_level int, delta int, reason string")
DELIVERY = struct(f"{HEAD}, {TIMES}, order_id string, store_id string, stage string, minutes_since_order double, rider_id string")

TOPICS = {"orders": ORDERS, "inventory_updates": INVENTORY, "delivery_status": DELIVERY}

WIRE = struct("key binary, value binary, partition int, offset bigint, timestamp timestamp")

# Fixed values of the event contract.
ORDER_STATUS = ["placed", "confirmed", "cancelled"]
DELIVERY_STAGES = ["assigned", "picked", "packed", "dispatched", "delivered"]
