"""Topics as sources and sinks, or files of messages where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewire.sources.files import json_messages, parse_messages


def read_topic(spark: SparkSession, topic: str, streaming: bool = True, offsets: str = "earliest") -> DataFrame:
    """Messages of ``topic``: from the broker that ``tidewire.kafka.servers`` names, else from the folder of JSON lines
    in ``tidewire.messages.dir``. Reading begins at the earliest message, so that none sent before the start is missed."""
    servers = spark.conf.get("tidewire.kafka.servers", None)
    reader = spark.readStream if streaming else spark.read
    if servers:
        options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": offsets}
        return reader.format("kafka").options(**options).load()
    return reader.format("text").load(f"{spark.conf.get('tidewire.messages.dir')}/{topic}")


def write_topic(df: DataFrame, topic: str) -> None:
    """Rows of ``df`` as JSON messages appended to ``topic``, or to its folder."""
    spark = df.sparkSession
    servers = spark.conf.get("tidewire.kafka.servers", None)
    out = json_messages(df).write
    if servers:
        out.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        out.mode("append").text(f"{spark.conf.get('tidewire.messages.dir')}/{topic}")


def drain(spark: SparkSession, topic: str, schema: StructType) -> DataFrame:
    """All messages of ``topic`` that there are now, parsed, and none that come later; ``count()`` and ``limit(3)`` of it are
    the consumer's report."""
    return parse_messages(read_topic(spark, topic, streaming=False), schema)
