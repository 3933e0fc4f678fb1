"""The change log as files of messages, and as a broker's topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.codec import encoded

MESSAGES = T.StructType().add("key", T.StringType()).add("value", T.StringType()).add("partition", T.IntegerType()).add("offset", T.LongType())


def publish(changes: DataFrame, path: str, partitions: int = 4, events: int = 0) -> None:
    """Append messages; rows of one key go to one log partition. ``offset`` must order each key's changes.

    Files hold at most ``events`` messages, if that is given, so that a stream of so many files a batch has bounded batches.
    """
    messages = encoded(changes).withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    messages.select(*MESSAGES.names).repartition(partitions, "partition").sortWithinPartitions("partition", "offset").write.option("maxRecordsPerFile", events).mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).parquet(path)


def stream_log(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over the log's files; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(MESSAGES)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, events: int = 500, age: str = "2s") -> DataFrame:
    """A stream over a broker's topic from its first offset, by size or age. Needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "minOffsetsPerTrigger": str(events), "maxTriggerDelay": age}
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset")


def publish_topic(changes: DataFrame, servers: str, topic: str) -> None:
    """Write messages to a topic, acknowledged by all replicas; Kafka's partitioner keeps a key in one partition."""
    encoded(changes).select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.linger.ms", "10").option("topic", topic).save()
