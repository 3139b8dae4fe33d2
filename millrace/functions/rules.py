"""Validation: ordered rules, the first that holds names the reason a row is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.schemas import DELIVERY_STAGES, ORDER_STATUS

REASON = "_dead_letter_reason"
Rules = list[tuple[str, Column]]
c = F.col


def missing(*names: str) -> Rules:
    return [(f"missing_{n}", c(n).isNull()) for n in names]


def order_rules() -> Rules:
    """Bounds are strict, and a null value satisfies no bound: such rows are clean."""
    return [*missing("event_id", "event_time", "store_id"),
            ("order_value_negative", c("order_value") < 0), ("order_value_implausible", c("order_value") > 100_000),
            ("unknown_status", ~c("status").isin(ORDER_STATUS)), ("negative_line_count", c("line_count") < 0)]


def inventory_rules() -> Rules:
    return [*missing("event_id", "event_time", "store_id", "sku"), ("negative_inventory", c("new_level") < 0)]


def delivery_rules() -> Rules:
    return [*missing("event_id", "event_time", "order_id"), ("unknown_stage", ~c("stage").isin(DELIVERY_STAGES)),
            ("negative_elapsed", c("minutes_since_order") < 0)]


def future_rule(limit: str = "1 day") -> Rules:
    """Optional: event times far ahead of their arrival, which would drag a watermark along."""
    return [("event_time_implausible", c("event_time") > c("ingest_time") + F.expr(f"interval {limit}"))]


#: the rules of each topic; expressions need a session, so they are built when asked for
TOPIC_RULES = {"orders": order_rules, "inventory_updates": inventory_rules, "delivery_status": delivery_rules}


def reason(rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def tagged(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn(REASON, reason(rules))


def split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(clean, dead): each row is in exactly one; clean rows have no reason column."""
    own = tagged(df, rules)
    return own.where(c(REASON).isNull()).drop(REASON), own.where(c(REASON).isNotNull())


def validate_orders(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, order_rules())


def validate_inventory(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, inventory_rules())


def validate_delivery(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, delivery_rules())


def add_column_if_missing(df: DataFrame, name: str | None = None, kind: str = "string") -> DataFrame:
    """Additive evolution: a nullable column if there is none of that name, never a change of one."""
    return df if name is None or name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def union_dead_letters(*parts: DataFrame) -> DataFrame:
    """Refused rows of several topics in one frame; columns a topic lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stamp_dead_letters(dead: DataFrame, topic: str) -> DataFrame:
    return dead.withColumns({"_dead_lettered_at": F.current_timestamp(), "_source_topic": F.lit(topic)})
