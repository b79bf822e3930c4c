"""Typed JSON streams: a codec, and create, get, append and read through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import media

JSON = "application/json"


class JsonCodec:
    """Values of a DDL schema. encode gives JSON text; decode gives a struct, and null for text that does not fit.

    check: a further test of a decoded value (a user's validation), as a function from column to column.
    """

    def __init__(self, schema: str, check=None):
        self.schema, self.check = schema, check

    def encode(self, value: Column) -> Column:
        return F.to_json(value)

    def decode(self, text: Column) -> Column:
        got = F.from_json(text, f"{self.schema}, bad_ string", {"columnNameOfCorruptRecord": "bad_"})
        fits = F.try_parse_json(text).isNotNull() & F.json_object_keys(text).isNotNull() & got["bad_"].isNull()
        if self.check is not None:
            fits = fits & F.coalesce(self.check(got), F.lit(False))
        return F.when(fits, F.struct(*[got[name].alias(name) for name in self._names()]))

    def _names(self) -> list[str]:
        from pyspark.sql.types import StructType

        return StructType.fromDDL(self.schema).fieldNames()


def get(streams: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether requested streams can be opened as JSON: not-found, gone, content-type-conflict or ok, with their type."""
    s = streams.select("stream_id", "content_type", F.coalesce("soft_deleted", F.lit(False)).alias("gone_"), F.lit(True).alias("there_"))
    got = requests.join(s, "stream_id", "left")
    status = F.when(F.col("there_").isNull(), "not-found").when(F.col("gone_"), "gone").when(~media.json_exact(F.col("content_type")), "content-type-conflict").otherwise("ok")
    return got.select("stream_id", status.alias("status"), "content_type")


def read(messages: DataFrame, codec: JsonCodec, key: str = "stream_id") -> DataFrame:
    """Per stream: status, values in order, and the offset of the first message that does not decode; one such fails the whole read."""
    m = messages.withColumn("value_", codec.decode(F.col("data").cast("string")))
    got = m.groupBy(key).agg(F.min(F.when(F.col("value_").isNull(), F.col("offset"))).alias("bad"), F.sort_array(F.collect_list(F.struct("offset", "value_"))).alias("m"))
    return got.select(key, F.when(F.col("bad").isNull(), "ok").otherwise("invalid-json").alias("status"), F.col("bad").alias("offset"), F.when(F.col("bad").isNull(), F.col("m.value_")).alias("values"))


def read_rows(messages: DataFrame, codec: JsonCodec, key: str = "stream_id") -> DataFrame:
    """Decoded messages of the streams that decode as a whole, a row each: no stream is gathered in one row."""
    m = messages.withColumn("value", codec.decode(F.col("data").cast("string")))
    bad = m.where("value is null").select(F.col(key).alias("bad_")).distinct()
    return m.join(bad, F.col(key) == F.col("bad_"), "left_anti")


def appends(values: DataFrame, codec: JsonCodec, value: str = "value") -> DataFrame:
    """Append attempts of values: body and content type set, the rest as given."""
    return values.withColumn("body", codec.encode(F.col(value)).cast("binary")).withColumn("content_type", F.lit(JSON)).drop(value)


def raw_appends(texts: DataFrame, text: str = "json") -> DataFrame:
    """Append attempts of JSON text past the codec; a top-level array becomes one message per item."""
    return texts.withColumn("body", F.col(text).cast("binary")).withColumn("content_type", F.lit(JSON)).drop(text)
