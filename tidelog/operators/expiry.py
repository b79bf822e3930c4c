"""Expiry as of a given time; clocks are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(expires_at_ms: Column, now_ms: int) -> Column:
    """The bound is inclusive; streams without one never expire."""
    return F.coalesce(expires_at_ms <= now_ms, F.lit(False))


def sliding(created: DataFrame, accesses: DataFrame) -> DataFrame:
    """created: stream_id, created_ms, ttl_seconds. accesses: stream_id, at_ms. Reads and appends slide the expiry.

    An access after expiry does not revive a stream, so the sequence matters only up to the first gap over the ttl.
    """
    from pyspark.sql import Window

    c = created.select("stream_id", F.col("created_ms").alias("at_ms")).withColumn("first", F.lit(True))
    a = c.unionByName(accesses.select("stream_id", "at_ms").withColumn("first", F.lit(False))).join(created.select("stream_id", "created_ms", "ttl_seconds"), "stream_id").where("at_ms >= created_ms")
    w = Window.partitionBy("stream_id").orderBy("at_ms", F.desc("first"))
    gap = F.col("at_ms") - F.lag("at_ms").over(w)
    a = a.withColumn("dead", F.coalesce((gap >= F.col("ttl_seconds") * 1000).cast("int"), F.lit(0)))
    a = a.withColumn("dead", F.sum("dead").over(w))
    return a.where("dead = 0").groupBy("stream_id").agg((F.max("at_ms") + F.first("ttl_seconds") * 1000).alias("expires_at_ms"))


def deadline(now_ms, ttl_seconds: Column, absolute: Column) -> Column:
    """When a stream made now expires: now plus its time to live, else its absolute time, else never."""
    from tidelog.functions.scalars import expires_at

    return expires_at(F.lit(now_ms) if isinstance(now_ms, int) else now_ms, ttl_seconds, absolute)


def touch(records: DataFrame, reads: DataFrame) -> DataFrame:
    """Records after reads (stream_id, at_ms, reason): streams with a time to live slide, live reads and absolute times do not."""
    at = reads.where("reason <> 'live-read'").groupBy(F.col("stream_id").alias("t_")).agg(F.max("at_ms").alias("touched_"))
    got = records.join(at, F.col("stream_id") == F.col("t_"), "left")
    slid = F.when(F.col("touched_").isNotNull() & F.col("ttl_seconds").isNotNull(), F.col("touched_") + F.col("ttl_seconds") * 1000)
    return got.withColumn("expires_at_ms", F.coalesce(slid, "expires_at_ms")).drop("t_", "touched_")


def access(records: DataFrame, dependents: DataFrame, now_ms: int) -> DataFrame:
    """What an access at now_ms finds (lazy expiry): an expired stream is deleted first and then read again.

    status: visible, gone (soft-deleted, or expired but kept for its forks) or not-found (expired and purged).
    """
    d = dependents.select(F.col("stream_id").alias("d_"), "dependents")
    got = records.join(d, F.col("stream_id") == F.col("d_"), "left")
    over = expired(F.col("expires_at_ms"), now_ms) & ~F.coalesce("soft_deleted", F.lit(False))
    status = F.when(F.coalesce("soft_deleted", F.lit(False)), "gone").when(over & (F.coalesce("dependents", F.lit(0)) > 0), "gone").when(over, "not-found").otherwise("visible")
    return got.select("stream_id", status.alias("status"))


def fire(timers: DataFrame, records: DataFrame) -> DataFrame:
    """Fired one-shot timers (stream_id, at_ms) looked at again: delete, re-arm at the place the expiry slid to, or drop."""
    r = records.select(F.col("stream_id").alias("r_"), "expires_at_ms")
    got = timers.join(r, F.col("stream_id") == F.col("r_"), "left")
    action = F.when(F.col("r_").isNull() | F.col("expires_at_ms").isNull(), "drop").when(F.col("expires_at_ms") <= F.col("at_ms"), "delete").otherwise("re-arm")
    return got.select("stream_id", "at_ms", action.alias("action"), F.when(action == "re-arm", F.col("expires_at_ms")).alias("next_ms"))
