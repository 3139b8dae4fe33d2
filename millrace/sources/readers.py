"""Sources: broker topics, file-backed topics, tables and in-memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.schemas import WIRE, struct

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def topic_options(bootstrap: str, topic: str, starting_offsets: str = "earliest", max_offsets: int = 50_000) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting_offsets,
            "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "true"}


def read_topic(spark: SparkSession, bootstrap: str, topic: str, starting_offsets: str = "earliest") -> DataFrame:
    """Unbounded broker topic; needs the connector on the class path."""
    return spark.readStream.format("kafka").options(**topic_options(bootstrap, topic, starting_offsets)).load()


def read_landed_topic(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same columns from a folder in which producers land JSON lines ``key, value, partition, offset, timestamp``."""
    text = struct("key string, value string, partition int, offset bigint, timestamp timestamp")
    rows = spark.readStream.schema(text).option("maxFilesPerTrigger", max_files).json(path)
    return rows.withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})


def land_topic(events: DataFrame, path: str, key: str = "store_id", time: str = "event_time") -> None:
    """Producer side of ``read_landed_topic``: events as JSON values, keyed and spread by store."""
    value = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    (events.select(F.col(key).alias("key"), value.alias("value"), F.pmod(F.xxhash64(key), F.lit(6)).cast("int").alias("partition"),
                   F.monotonically_increasing_id().alias("offset"), F.col(time).cast("timestamp").alias("timestamp"))
     .write.mode("append").json(path))


def wire_rows(spark: SparkSession, values: list[tuple[str | None, str | None]]) -> DataFrame:
    """In-memory (key, JSON) pairs with the columns of a topic."""
    rows = [(k and k.encode(), None if v is None else v.encode(), 0, i, None) for i, (k, v) in enumerate(values)]
    return spark.createDataFrame(rows, WIRE)


def read_table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table folder as a stream; event times without a zone become instants, as watermarks need."""
    return with_instants(spark.readStream.schema(schema).parquet(path))


def with_instants(df: DataFrame) -> DataFrame:
    own = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(own) if own else df


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Bulk read by wildcard."""
    return spark.read.parquet(pattern)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
