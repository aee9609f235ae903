"""Message topics as batch and streaming sources and as sinks.

The format is an argument: "kafka" where the connector is installed, "text" for landed message
files (one message per line) and "parquet" for landed records. All give a `value` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

KAFKA_COLUMNS = ["key", "value", "partition", "offset", "timestamp"]

# Delivery settings of the tick producer.
KAFKA_SINK_OPTIONS = {"kafka.acks": "all", "kafka.retries": "5", "kafka.retry.backoff.ms": "500"}


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    """Read a topic from its beginning; afterwards the checkpoint holds the offsets."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic,
            "startingOffsets": "earliest"}


def read_topic_stream(spark: SparkSession, format: str, options: dict[str, str],
                      schema: StructType | str | None = None) -> DataFrame:
    reader = spark.readStream.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    records = reader.load()
    return records.select(*KAFKA_COLUMNS) if format == "kafka" else records


def read_topic(spark: SparkSession, format: str, options: dict[str, str],
               schema: StructType | str | None = None) -> DataFrame:
    """All messages landed so far, as a batch."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    records = reader.load()
    return records.select(*KAFKA_COLUMNS) if format == "kafka" else records


def write_topic(records: DataFrame, format: str, options: dict[str, str]) -> None:
    """Publish key/value records as a batch; other formats append files."""
    if format == "kafka":
        records.write.format("kafka").options(**{**KAFKA_SINK_OPTIONS, **options}).save()
    else:
        records.write.format(format).options(**options).mode("append").save()


def topic_writer(records: DataFrame, format: str, options: dict[str, str]) -> DataStreamWriter:
    """A streaming writer that publishes key/value records."""
    defaults = KAFKA_SINK_OPTIONS if format == "kafka" else {}
    return records.writeStream.format(format).options(**{**defaults, **options})
