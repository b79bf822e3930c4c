"""Creates and forks as records with their first messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import media, offsets
from tidelog.operators import admit, expiry, lineage

RECORD = (
    "stream_id string, content_type string, ttl_seconds long, expires_at string, created_ms long, last_seq string, closed boolean, closed_at long, forked_from string, fork_offset string, "
    "fork_sub_offset long, soft_deleted boolean, expires_at_ms long, current_offset string"
)
_FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_CONFIG = ("content_type", "forked_from", "fork_offset", "fork_sub_offset", "ttl_seconds", "expires_at", "closed")


def framed_bytes(body: Column, content_type: Column) -> Column:
    """Messages of a body (bytes) as an array of bytes; null for invalid JSON, none for no body."""
    items = F.transform(media.framed(body.cast("string"), F.lit(True)), lambda x: x.cast("binary"))
    return F.when(body.isNull() | (F.octet_length(body) == 0), F.array().cast("array<binary>")).when(media.json_by_prefix(content_type), items).otherwise(F.array(body))


def messages_of(accepted: DataFrame, items: str, before: str, now_ms: int, scheme) -> DataFrame:
    """A row per message of accepted bodies, with offsets that follow the tail `before`."""
    m = accepted.select("stream_id", F.col(before).alias("before_"), F.posexplode(items).alias("pos", "data"))
    return m.select("stream_id", scheme.column(scheme.number(F.col("before_")) + F.col("pos") + 1).alias("offset"), F.lit(now_ms).cast("long").alias("timestamp"), "data")


def plan(requests: DataFrame, records: DataFrame, now_ms: int, scheme=None, messages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Creates and forks of a batch: (decisions, messages).

    requests: stream_id, arrival, content_type, ttl_seconds, expires_at, closed, body, forked_from, fork_offset, fork_sub_offset.
    The first request of a new stream makes it if its source and body allow; a stream that is there already, also by an
    earlier request of the batch, answers exists or conflict. Sources are streams of `records`; messages are needed for sub-offsets.
    decisions: stream_id, arrival, status, next_offset and, where created, the record's fields.
    """
    scheme = scheme or offsets.DefaultOffsets()
    zero = scheme.column(F.lit(0).cast("long"))
    q = requests.withColumn("body", F.when(F.octet_length("body") > 0, F.col("body")))
    source = records.select(
        F.col("stream_id").alias("src_"), F.col("content_type").alias("src_type"), F.col("ttl_seconds").alias("src_ttl"), F.col("expires_at").alias("src_at"), F.col("soft_deleted").alias("src_deleted"), F.col("current_offset").alias("src_tail"),
    )
    q = q.join(source, F.col("forked_from") == F.col("src_"), "left")
    is_fork = F.col("forked_from").isNotNull()
    place = F.coalesce("fork_offset", "src_tail")
    own_type = F.when(F.trim(F.coalesce("content_type", F.lit(""))) != "", F.col("content_type"))
    kind = F.coalesce(own_type, F.when(is_fork, F.col("src_type")).otherwise("application/octet-stream"))
    ttl, at = lineage.fork_expiry(F.col("ttl_seconds"), F.col("expires_at"), F.col("src_ttl"), F.col("src_at"))
    q = q.select("*", kind.alias("type_"), F.when(is_fork, place).alias("place_"), F.when(is_fork, ttl).otherwise(F.col("ttl_seconds")).alias("ttl_"), F.when(is_fork, at).otherwise(F.col("expires_at")).alias("at_"))
    q = _prefixes(q, records, messages)
    items = F.concat(F.coalesce("prefix_", F.array().cast("array<binary>")), framed_bytes(F.col("body"), F.col("type_")))
    q = q.withColumn("items_", items).withColumn("start_", F.when(is_fork, F.col("place_")).otherwise(zero))
    sub = F.coalesce("fork_sub_offset", F.lit(0)) > 0
    source_verdict = lineage.fork_verdict(F.col("src_").isNotNull(), F.col("src_deleted"), F.coalesce(scheme.valid(F.col("place_")), F.lit(False)), F.col("place_"), F.col("src_tail"))
    verdict = F.when(is_fork & (source_verdict != "created"), source_verdict).when(is_fork & own_type.isNotNull() & ~media.media_matches(own_type, F.col("src_type")), "conflict")
    verdict = verdict.when(is_fork & sub & F.col("prefix_").isNull(), "bad-request").when(F.col("items_").isNull(), "bad-request").otherwise("created")
    q = q.withColumn("verdict_", verdict)
    # who is there: a stored record, else the first request of the batch that makes one
    w = Window.partitionBy("stream_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = F.when(F.col("verdict_") == "created", F.struct("arrival", F.col("type_").alias("content_type"), "forked_from", F.col("place_").alias("fork_offset"), "fork_sub_offset", F.col("ttl_").alias("ttl_seconds"), F.col("at_").alias("expires_at"), "closed"))
    stored = records.select(F.col("stream_id").alias("have_"), F.col("soft_deleted").alias("have_deleted"), F.col("current_offset").alias("have_tail"), F.struct(*_CONFIG).alias("have"))
    q = q.withColumn("first_", F.first(made, ignorenulls=True).over(w)).join(stored, F.col("stream_id") == F.col("have_"), "left")
    config = lambda s: {c: F.col(f"{s}.{c}") for c in _CONFIG}
    # a request that names no type takes what is there
    ask = lambda s: {c: F.col(c) for c in _CONFIG} | {"content_type": F.coalesce(own_type, F.col(f"{s}.content_type"))}
    same = F.when(F.col("have_").isNotNull(), admit.config_matches(config("have"), ask("have"))).otherwise(admit.config_matches(config("first_"), ask("first_")))
    mine = F.col("first_.arrival") == F.col("arrival")
    status = (
        F.when(F.col("have_").isNotNull() & F.coalesce("have_deleted", F.lit(False)), "conflict").when(F.col("have_").isNotNull(), F.when(same, "exists").otherwise("conflict"))
        .when(F.col("first_").isNull() | mine, F.col("verdict_")).otherwise(F.when(same, "exists").otherwise("conflict"))
    )
    tail = scheme.column(scheme.number(F.col("start_")) + F.size("items_"))
    q = q.withColumn("status", status).withColumn("tail_", F.when(F.col("status") == "created", tail).when(F.col("status") == "exists", F.col("have_tail")))
    deadline = expiry.deadline(now_ms, F.col("ttl_"), F.col("at_"))
    closed = F.coalesce("closed", F.lit(False)) & ~is_fork  # a fork is made open, whatever it asks
    fields = {
        "content_type": F.col("type_"), "ttl_seconds": F.col("ttl_"), "expires_at": F.col("at_"), "created_ms": F.lit(now_ms), "last_seq": F.lit(None), "closed": closed, "closed_at": F.when(closed, now_ms), "forked_from": F.col("forked_from"),
        "fork_offset": F.col("place_"), "fork_sub_offset": F.when(sub, F.col("fork_sub_offset")), "soft_deleted": F.lit(False), "expires_at_ms": deadline, "current_offset": F.col("tail_"),
    }
    types = dict(x.split() for x in RECORD.split(", "))
    record = [F.when(F.col("status") == "created", v).cast(types[k]).alias(k) for k, v in fields.items()]
    decided = q.select("stream_id", "arrival", "status", F.col("tail_").alias("next_offset"), *record)
    return decided, messages_of(q.where("status = 'created'"), "items_", "start_", now_ms, scheme)


def _prefixes(q: DataFrame, records: DataFrame, messages: DataFrame | None) -> DataFrame:
    """Adds prefix_: what a sub-offset takes from the source after the fork's place; null where there is not as much."""
    if messages is None:
        return q.withColumn("prefix_", F.lit(None).cast("array<binary>"))
    asks = q.where("fork_sub_offset > 0 and place_ is not null").select(F.col("stream_id").alias("q_"), F.col("arrival").alias("q_arrival"), "forked_from", "place_", "fork_sub_offset", media.json_by_prefix(F.col("type_")).alias("json_"))
    chain = lineage.chain_read(messages, records.join(asks.select(F.col("forked_from").alias("a_")).distinct(), F.col("stream_id") == F.col("a_"), "left_semi"), others=records)
    tail = asks.join(chain.select(F.col("stream_id").alias("c_"), "offset", "data"), (F.col("forked_from") == F.col("c_")) & (F.col("offset") > F.col("place_")))
    w = Window.partitionBy("q_", "q_arrival").orderBy("offset")
    near = tail.withColumn("k_", F.row_number().over(w)).where(F.when(F.col("json_"), F.col("k_") <= F.col("fork_sub_offset")).otherwise(F.col("k_") == 1))
    got = near.groupBy("q_", "q_arrival", "json_", "fork_sub_offset").agg(F.sort_array(F.collect_list(F.struct("k_", "data"))).alias("m"))
    first = F.col("m")[0]["data"]
    taken = F.when(F.col("json_"), F.when(F.size("m") == F.col("fork_sub_offset"), F.col("m.data"))).otherwise(F.when(F.octet_length(first) >= F.col("fork_sub_offset"), F.array(lineage.byte_prefix(first, F.col("fork_sub_offset").cast("int")))))
    got = got.select("q_", "q_arrival", taken.alias("prefix_"))
    return q.join(got, (F.col("stream_id") == F.col("q_")) & (F.col("arrival") == F.col("q_arrival")), "left").drop("q_", "q_arrival")
