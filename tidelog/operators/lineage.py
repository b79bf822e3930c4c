"""Forks: reads through ancestors, dependents, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.sources.shared import cut


def ancestry(streams: DataFrame) -> DataFrame:
    """(leaf, ancestor, hi, depth): what each stream sees of itself (hi null) and of each ancestor (offsets up to hi).

    streams: stream_id, forked_from, fork_offset. The cap of an ancestor is the least fork offset on the way. Paths
    double at every step, so a chain of length L takes log2 L joins; ancestors without a record give nothing. Forks that form a circle are an error.
    """
    streams = cut(streams.select("stream_id", "forked_from", "fork_offset"), "streams")
    there = streams.select(F.col("stream_id").alias("there_")).distinct()
    known = streams.where("forked_from is not null").join(there, F.col("forked_from") == F.col("there_"), "left_semi")
    edge = known.select(F.col("stream_id").alias("leaf"), F.col("forked_from").alias("ancestor"), F.col("fork_offset").alias("hi"), F.lit(1).alias("depth"))
    paths, reach, most = edge, 1, streams.count()
    while True:
        ahead = paths.where(F.col("depth") <= reach)
        tail = ahead.select(F.col("leaf").alias("l2"), F.col("ancestor").alias("a2"), F.col("hi").alias("h2"), F.col("depth").alias("d2"))
        longer = cut(paths.where(F.col("depth") == reach).join(tail, F.col("ancestor") == F.col("l2")).select("leaf", F.col("a2").alias("ancestor"), F.least("hi", "h2").alias("hi"), (F.col("depth") + F.col("d2")).alias("depth")), "paths")
        if longer.isEmpty():
            break
        if reach >= most:  # a path of more steps than there are streams
            raise ValueError("forks form a circle")
        paths = paths.unionByName(longer)
        reach *= 2
    own = streams.select(F.col("stream_id").alias("leaf"), F.col("stream_id").alias("ancestor"), F.lit(None).cast("string").alias("hi"), F.lit(0).alias("depth"))
    return own.unionByName(paths)


def chain_read(messages: DataFrame, streams: DataFrame, after: str | None = None, others: DataFrame | None = None) -> DataFrame:
    """All messages every stream sees, with the stream they come from. One equi-join by ancestor; the cap is a residual test.

    others: all records, where `streams` are only the ones to read.
    """
    a = ancestry(streams if others is None else others)
    if others is not None:
        a = a.join(streams.select(F.col("stream_id").alias("leaf")).distinct(), "leaf")
    m = messages.withColumnRenamed("stream_id", "origin")
    got = m.join(a, F.col("origin") == F.col("ancestor")).where(F.col("hi").isNull() | (F.col("offset") <= F.col("hi")))
    if after:
        got = got.where(F.col("offset") > after)
    return got.withColumnRenamed("leaf", "stream_id").drop("ancestor", "hi")


def dependents(streams: DataFrame) -> DataFrame:
    """Forks per stream; soft-deleted ones count while their record is there."""
    n = streams.where("forked_from is not null").groupBy(F.col("forked_from").alias("f_")).agg(F.count("*").alias("n"))
    return streams.join(n, F.col("stream_id") == F.col("f_"), "left").select("stream_id", F.coalesce("n", F.lit(0)).alias("dependents"))


POLICIES = {
    "ref-count": lambda n: n,
    "reverse-index": lambda n: n,
    "copy-on-fork": lambda n: F.lit(0),
    "ttl-only": lambda n: F.lit(1),
}


def delete_status(streams: DataFrame, policy: str = "reverse-index") -> DataFrame:
    """What deleting each stream alone would do."""
    d = streams.join(dependents(streams), "stream_id")
    status = F.when(F.coalesce("soft_deleted", F.lit(False)), "gone").when(POLICIES[policy](F.col("dependents")) > 0, "retained-soft-deleted").otherwise("purged")
    return d.select("stream_id", "dependents", status.alias("status"))


def cascade(streams: DataFrame, deleted: DataFrame) -> DataFrame:
    """Streams after deleting all of `deleted` (stream_id): soft-deleted ones without forks left go, upward, to a fixpoint.

    The outcome does not depend on the order of deletes: a deleted stream stays exactly while it has a descendant that
    is not deleted. So it is found from the ancestors of the streams that live on.
    """
    d = deleted.select(F.col("stream_id").alias("d_")).distinct()
    marked = streams.join(d, F.col("stream_id") == F.col("d_"), "left").withColumn("soft_deleted", F.coalesce("soft_deleted", F.lit(False)) | F.col("d_").isNotNull()).drop("d_")
    alive = marked.where("not soft_deleted").select(F.col("stream_id").alias("leaf"))
    needed = ancestry(streams).join(alive, "leaf").select(F.col("ancestor").alias("n_")).distinct()
    return marked.join(needed, F.col("stream_id") == F.col("n_"), "left").withColumn("status", F.when(~F.col("soft_deleted"), "visible").when(F.col("n_").isNotNull(), "retained-soft-deleted").otherwise("purged")).drop("n_")


def source_live(present: Column, soft_deleted: Column, current_offset: Column, live_at: Column) -> Column:
    """Whether a fork's source is still there, visible, and as far as the fork's place."""
    return F.coalesce(present & ~F.coalesce(soft_deleted, F.lit(False)) & (current_offset >= live_at), F.lit(False))


def child_edges(edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The set of (parent, child) edges after adding and removing some; both may be repeated without effect."""
    return edges.unionByName(added).dropDuplicates(["parent", "child"]).join(removed, ["parent", "child"], "left_anti")


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Messages, producers and records without the given streams: all three go together."""
    gone = ids.select(F.col("stream_id").alias("gone_")).distinct()
    return {name: df.join(gone, F.col("stream_id") == F.col("gone_"), "left_anti") for name, df in tables.items()}


def fork_verdict(source_present: Column, soft_deleted: Column, valid_offset: Column, fork_offset: Column, tail: Column) -> Column:
    return F.when(~source_present, "not-found").when(F.coalesce(soft_deleted, F.lit(False)), "conflict").when(~valid_offset | (fork_offset > tail), "bad-request").otherwise("created")


def fork_expiry(own_ttl: Column, own_at: Column, source_ttl: Column, source_at: Column) -> tuple[Column, Column]:
    """(ttl, expires_at): own ttl, own time, the source's ttl, the source's time; exactly one wins."""
    ttl = F.when(own_ttl.isNotNull(), own_ttl).when(own_at.isNotNull(), None).otherwise(source_ttl)
    at = F.when(own_ttl.isNotNull(), None).when(own_at.isNotNull(), own_at).when(source_ttl.isNotNull(), None).otherwise(source_at)
    return ttl, at


def byte_prefix(data: Column, n: Column) -> Column:
    """First n bytes of the next message, null (bad request) where it is shorter."""
    return F.when(F.octet_length(data) >= n, F.substring(data, F.lit(1), n))
