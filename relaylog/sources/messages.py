"""Batch and stream sources with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relaylog.schema import MESSAGE


def read_messages(spark: SparkSession, path: str, schema: T.StructType = MESSAGE, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def stream_messages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = MESSAGE,
    fmt: str = "parquet",
    files: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Folder stream; ``files`` is a name pattern, ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType = MESSAGE) -> DataFrame:
    """Topic stream of JSON messages; needs the Kafka connector on the class path."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
