"""Streams as JSON-lines files: one directory per stream, one line per message.

A line is {"offset", "timestamp", "json"} for valid JSON of a JSON stream, else {"offset", "timestamp", "b64"}.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.media import base64_plain


def encode(messages: DataFrame, json_stream="json_stream") -> DataFrame:
    """Adds line, from offset, timestamp, data (text) and a flag that the stream is JSON."""
    head = F.concat(F.lit('{"offset":"'), "offset", F.lit('","timestamp":'), F.col("timestamp").cast("string"))
    text = F.col("data").cast("string")
    # only what comes back as the same bytes is written as text
    inline = F.col(json_stream) & F.try_parse_json(text).isNotNull() & F.is_valid_utf8(text)
    body = F.when(inline, F.concat(F.lit(',"json":'), text)).otherwise(F.concat(F.lit(',"b64":"'), base64_plain(F.col("data").cast("binary")), F.lit('"')))
    return messages.withColumn("line", F.concat(head, body, F.lit("}")))


def decode(lines: DataFrame, keys: list[str], binary: bool = False) -> DataFrame:
    """Messages from lines in physical order (line_no): malformed lines are skipped, the last line of an offset wins.

    binary: data as bytes, as they were written; else as text.
    """
    fields = F.from_json("line", "offset string, timestamp long, json string, b64 string")
    got = lines.where(F.try_parse_json("line").isNotNull()).withColumn("r", fields).where("r.offset is not null and (r.json is not null or r.b64 is not null)")
    data = F.coalesce(F.col("r.json").cast("binary"), F.unbase64("r.b64"))
    data = data if binary else data.cast("string")
    got = got.select(*keys, F.col("r.offset").alias("offset"), "line_no", F.struct(F.col("r.timestamp").alias("timestamp"), data.alias("data")).alias("m"))
    return got.groupBy(*keys, "offset").agg(F.max_by("m", "line_no").alias("m")).select(*keys, "offset", "m.timestamp", "m.data")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of all files of a folder, with their numbers: a number grows with the line's place in its file.

    Files are split as Spark splits text, so one large file is many tasks' work.
    """
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"))
