"""Scans of the message log and of stream records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import offsets


def window(offset: Column, after: str | None = None, until: str | None = None) -> Column:
    """After is exclusive, until inclusive; an empty after is no bound."""
    test = F.lit(True)
    if after:
        test = test & (offset > after)
    if until is not None:
        test = test & (offset <= until)
    return test


def range_scan(messages: DataFrame, stream_id: str, after: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """One stream in ascending order; the limit counts after windowing. Filters reach the file scan."""
    got = messages.where((F.col("stream_id") == stream_id) & window(F.col("offset"), after, until)).orderBy("offset")
    return got if limit is None else got.limit(limit)


def windowed(messages: DataFrame, bounds: DataFrame) -> DataFrame:
    """Many range scans at once. bounds: stream_id, after, until (null: open)."""
    b = bounds.select(F.col("stream_id").alias("s_"), offsets.read_start(F.col("after")).alias("after_"), F.col("until").alias("until_"))
    got = messages.join(b, F.col("stream_id") == F.col("s_"))
    return got.where((F.col("after_").isNull() | (F.col("offset") > F.col("after_"))) & (F.col("until_").isNull() | (F.col("offset") <= F.col("until_")))).drop("s_", "after_", "until_")


def catch_up(messages: DataFrame, streams: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request (stream_id, from): status, number of messages, next_offset, up_to_date, closed.

    Rows beyond a stream's tail are crash leftovers and are not seen.
    """
    r = requests.select("stream_id", "from", offsets.read_start(F.col("from")).alias("after_")).join(streams.select("stream_id", "current_offset", "closed", "soft_deleted"), "stream_id", "left")
    m = messages.select(F.col("stream_id").alias("s_"), "offset")
    j = r.join(m, (F.col("stream_id") == F.col("s_")) & (F.col("offset") <= F.col("current_offset")) & (F.col("after_").isNull() | (F.col("offset") > F.col("after_"))), "left")
    got = j.groupBy("stream_id", "from", "current_offset", "closed", "soft_deleted").agg(F.count("offset").alias("n_messages"), F.max("offset").alias("last"))
    status = visibility(F.col("current_offset").isNotNull(), F.col("soft_deleted"))
    seen = status == "visible"
    nxt = F.coalesce("last", offsets.read_start(F.col("from")), "current_offset")
    return got.select("stream_id", "from", status.alias("status"), F.when(seen, F.col("n_messages")).otherwise(0).alias("n_messages"), F.when(seen, nxt).alias("next_offset"), F.when(seen, nxt >= F.col("current_offset")).alias("up_to_date"), F.when(seen, F.coalesce("closed", F.lit(False)) & (nxt >= F.col("current_offset"))).alias("closed"))


def tail(streams: DataFrame) -> DataFrame:
    """Reading from `now`: no data, only the tail; answered from records alone."""
    return streams.select("stream_id", F.col("current_offset").alias("next_offset"))


def visibility(present: Column, soft_deleted: Column) -> Column:
    return F.when(~present, "not-found").when(F.coalesce(soft_deleted, F.lit(False)), "gone").otherwise("visible")


def metadata(streams: DataFrame) -> DataFrame:
    status = visibility(F.lit(True), F.col("soft_deleted"))
    return streams.select("stream_id", status.alias("status"), "content_type", F.col("current_offset").alias("next_offset"), "ttl_seconds", "expires_at", F.coalesce("closed", F.lit(False)).alias("closed"))


def snapshot_differs(present: Column, soft_deleted: Column, closed: Column, offset: Column, was_deleted: Column, was_closed: Column, from_offset: Column) -> Column:
    """Change is inequality of offsets: a stream made anew may have a lower one."""
    no = F.lit(False)
    return ~present | (F.coalesce(soft_deleted, no) & ~F.coalesce(was_deleted, no)) | (F.coalesce(closed, no) & ~F.coalesce(was_closed, no)) | ~offset.eqNullSafe(from_offset)


def visible_tail(messages: DataFrame, streams: DataFrame) -> DataFrame:
    """Messages up to their stream's tail."""
    return messages.join(streams.select("stream_id", "current_offset"), "stream_id").where(F.col("offset") <= F.col("current_offset")).drop("current_offset")


def lookup(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Point lookups of many keys at once: every key with its row, or nulls where there is none."""
    return keys.join(table, on, "left")


def commits(messages: DataFrame, streams: DataFrame) -> DataFrame:
    """A commit event per message beyond the initial offset: stream, offset, closed and soft-deleted flags, no body."""
    s = streams.select("stream_id", F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce("soft_deleted", F.lit(False)).alias("soft_deleted"))
    return messages.where(F.col("offset") != offsets.ZERO).select("stream_id", "offset").join(s, "stream_id")


def live_start(offset: Column, scheme=None) -> Column:
    """Where a live read stands: any offset that is not valid is the initial one."""
    scheme = scheme or offsets.DefaultOffsets()
    return F.when(F.coalesce(scheme.valid(offset), F.lit(False)), offset).otherwise(scheme.column(F.lit(0).cast("long")))


def live_step(messages: DataFrame, streams: DataFrame, readers: DataFrame, scheme=None) -> DataFrame:
    """One evaluation of live reads (readers: stream_id, from): status, n_messages, next_offset, closed.

    Level-triggered: the answer depends on what is there, not on what woke it. not-found and gone as for any read; ok with
    messages after the place; a closed stream drains and says so at its tail; else timeout. A tail that is ahead of what
    can be listed does not move the reader (the visibility guard).
    """
    s = streams.select("stream_id", "current_offset", F.coalesce("closed", F.lit(False)).alias("closed_"), F.coalesce("soft_deleted", F.lit(False)).alias("deleted_"))
    r = readers.select("stream_id", "from", live_start(F.col("from"), scheme).alias("after_")).join(s, "stream_id", "left")
    m = messages.select(F.col("stream_id").alias("s_"), "offset")
    got = r.join(m, (F.col("stream_id") == F.col("s_")) & (F.col("offset") > F.col("after_")), "left")
    got = got.groupBy("stream_id", "from", "after_", "current_offset", "closed_", "deleted_").agg(F.count("offset").alias("n"), F.max("offset").alias("last"))
    seen = visibility(F.col("current_offset").isNotNull(), F.col("deleted_"))
    ok = seen == "visible"
    behind = F.col("after_") < F.col("current_offset")
    nxt = F.when(F.col("closed_"), F.greatest(F.coalesce("last", "current_offset"), "current_offset")).otherwise(F.coalesce("last", F.when(behind, F.col("after_")), "current_offset"))
    return got.select(
        "stream_id", "from", F.when(~ok, seen).when(F.col("n") > 0, "ok").otherwise("timeout").alias("status"), F.when(ok, F.col("n")).otherwise(0).alias("n_messages"),
        F.when(ok, nxt).alias("next_offset"), F.when(ok, F.col("closed_") & (nxt == F.col("current_offset"))).alias("closed"),
    )
