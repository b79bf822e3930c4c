"""The log as Parquet: files clustered by (stream_id, offset), so range scans prune row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "stream_id string, offset string, timestamp long, data binary"


def write(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Range-partitioned rather than one directory per stream: a hot stream spreads over several files."""
    messages.repartitionByRange("stream_id", "offset").sortWithinPartitions("stream_id", "offset").write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def tail_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Live reads: new files only, at most so many per micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
