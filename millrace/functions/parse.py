"""Wire rows to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The columns of a wire row that the raw layer keeps before the payload, and where they come from.
ADDRESS = {"_kafka_key": "cast(key as string)", "_kafka_partition": "partition", "_kafka_offset": "offset", "_kafka_timestamp": "timestamp"}


def parse_topic(wire: DataFrame, schema: StructType, dated: bool = True) -> DataFrame:
    """Payload fields of the JSON value, with key, position and arrival of the wire row.

    Lenient: unknown fields are dropped, a field of the wrong type is null, and a value that is no
    JSON keeps its row with null fields. ``dated`` adds the partition column of the raw layer.
    """
    arrived = F.current_timestamp()
    stamps = {"_ingested_at": arrived} | ({"_ingest_date": F.to_date(arrived)} if dated else {})
    address = [F.expr(source).alias(name) for name, source in ADDRESS.items()]
    return wire.select(*address, F.from_json(wire["value"].cast("string"), schema).alias("_")).select(*ADDRESS, "_.*").withColumns(stamps)
