"""Admission of creates and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import media, offsets
from tidelog.operators.fold import ordered_fold

#: HTTP codes of append results.
APPEND_CODES = [
    ("appended", 204), ("duplicate", 204), ("not-found", 404), ("gone", 410), ("conflict:closed", 409), ("conflict:expected-offset", 409),
    ("conflict:content-type", 409), ("conflict:sequence", 409), ("busy", 503), ("stale-epoch", 403), ("producer-gap", 409), ("invalid-epoch-seq", 400), ("bad-request", 400),
]


def status_codes(spark) -> DataFrame:
    return spark.createDataFrame(APPEND_CODES, "status string, code int")


def allocate_offsets(attempts: DataFrame, order: list[str], scheme=offsets.default_offset) -> DataFrame:
    """Strictly growing offsets per stream, one per message."""
    w = Window.partitionBy("stream_id").orderBy(*order)
    return attempts.withColumn("offset", scheme(F.row_number().over(w).cast("long")))


def seq_guard(attempts: DataFrame, order: list[str]) -> DataFrame:
    """A writer sequence is accepted when it is above all before it; rejected ones are never above the accepted maximum."""
    w = Window.partitionBy("stream_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seq = F.when(F.col("seq") != "", F.col("seq"))
    before = F.max(seq).over(w)
    return attempts.withColumn("accepted", seq.isNull() | before.isNull() | (seq > before))


def producer_decision(state: tuple | None, epoch: int, seq: int) -> str:
    """Verdict of the idempotent-producer rules on (epoch, last sequence)."""
    if state is None:
        return "accepted" if seq == 0 else "producer-gap"
    known, last = state
    if epoch < known:
        return "stale-epoch"
    if epoch > known:
        return "accepted" if seq == 0 else "invalid-epoch-seq"
    if seq <= last:
        return "duplicate"
    return "accepted" if seq == last + 1 else "producer-gap"


def admit_producers(attempts: DataFrame, order: list[str]) -> DataFrame:
    """stream_id, producer_id, arrival, status and the state after each attempt."""

    def step(state, row):
        stream, producer, arrival, epoch, seq = row
        status = producer_decision(state, epoch, seq)
        if status == "accepted":
            state = (epoch, seq)
        return state, (stream, producer, arrival, status, *(state or (None, None)))

    cols = ["stream_id", "producer_id", "arrival", "producer_epoch", "producer_seq"]
    return ordered_fold(attempts.select(*cols), ["stream_id", "producer_id"], order, lambda: None, step, "stream_id string, producer_id string, arrival long, status string, epoch long, last_seq long")


class _Stream:
    def __init__(self, exists: bool):
        self.n, self.exists, self.gone, self.closed, self.seq, self.producers = 0, exists, False, False, None, {}


_ATTEMPT = ["stream_id", "arrival", "n_messages", "type_ok", "seq", "producer_id", "producer_epoch", "producer_seq", "close", "expected_offset", "has_body", "kind"]
_ADMITTED = "stream_id string, arrival long, status string, before string, tail string, closed boolean, last_seq string, changed boolean, producer_id string, epoch long, producer_seq long"


def _append(text):
    """One attempt; the order of the rules matters: record, producer, close-only, closed, content type, sequence, expected offset, body.

    Rows of kind 0 bring a stream's record (n_messages: messages so far), of kind 1 a producer's state, of kind 2 an attempt.
    """

    def step(s: _Stream, row: tuple) -> tuple[_Stream, tuple | None]:
        stream, arrival, n, type_ok, seq, pid, epoch, pseq, close, expected, has_body, kind = row
        if kind == 0:
            s.exists, s.n, s.closed, s.gone, s.seq = True, n, bool(close), bool(type_ok), seq
            return s, None
        if kind == 1:
            s.producers[pid] = (epoch, pseq)
            return s, None
        before, status, changes = text(s.n), None, False
        if not s.exists:
            return s, (stream, arrival, "not-found", None, None, None, None, False, None, None, None)
        if s.gone:
            status = "gone"
        elif pid is not None:
            verdict = producer_decision(s.producers.get(pid), epoch, pseq)
            status = None if verdict == "accepted" else verdict
        stale = expected is not None and expected != before
        if status is None:
            if close and not has_body:
                status = "appended" if s.closed or not stale else "conflict:expected-offset"
                changes = not s.closed and status == "appended"
            elif s.closed:
                status = "conflict:closed"
            elif not type_ok:
                status = "conflict:content-type"
            elif seq and s.seq is not None and seq <= s.seq:
                status = "conflict:sequence"
            elif stale:
                status = "conflict:expected-offset"
            elif n is None:
                status = "bad-request"
            else:
                status, changes = "appended", True
        if changes:
            s.n += n or 0
            s.closed = s.closed or bool(close)
            s.seq = seq or s.seq
            if pid is not None:
                s.producers[pid] = (epoch, pseq)
        state = s.producers.get(pid) if pid is not None else None
        return s, (stream, arrival, status, before, text(s.n), s.closed, s.seq, changes, pid, *(state or (None, None)))

    return step


def admit_appends(attempts: DataFrame, order: list[str], records: DataFrame | None = None, producers: DataFrame | None = None, scheme=None) -> DataFrame:
    """The whole append decision per stream, in order: status, tail before and after, closed, last_seq, changed, producer's state.

    attempts: stream_id, arrival, n_messages (null: the body is no valid JSON), type_ok, seq, producer_id, producer_epoch,
    producer_seq, close, expected_offset, and has_body (bytes, not messages: a body [] has some; else taken from
    n_messages). Only these columns travel; payloads are joined back by (stream_id, arrival).
    records: stream_id, current_offset, closed, soft_deleted, last_seq of the streams there are, and producers: stream_id,
    producer_id, epoch, last_seq. Without records every stream is there and empty.
    """
    scheme = scheme or offsets.DefaultOffsets()
    a = attempts if "has_body" in attempts.columns else attempts.withColumn("has_body", F.col("n_messages") > 0)
    a = a.withColumn("kind", F.lit(2)).select(*_ATTEMPT)
    null = lambda t: F.lit(None).cast(t)
    if records is not None:
        r = records.select(
            "stream_id", null("long").alias("arrival"), scheme.number(F.col("current_offset")).alias("n_messages"), F.coalesce("soft_deleted", F.lit(False)).alias("type_ok"), F.col("last_seq").alias("seq"), null("string").alias("producer_id"),
            null("long").alias("producer_epoch"), null("long").alias("producer_seq"), F.coalesce("closed", F.lit(False)).alias("close"), null("string").alias("expected_offset"), F.lit(False).alias("has_body"), F.lit(0).alias("kind"),
        )
        a = a.unionByName(r)
        if producers is not None:
            p = producers.select(
                "stream_id", null("long").alias("arrival"), F.lit(0).cast("long").alias("n_messages"), F.lit(True).alias("type_ok"), null("string").alias("seq"), "producer_id", F.col("epoch").alias("producer_epoch"),
                F.col("last_seq").alias("producer_seq"), F.lit(False).alias("close"), null("string").alias("expected_offset"), F.lit(False).alias("has_body"), F.lit(1).alias("kind"),
            )
            a = a.unionByName(p)
    there = records is None
    return ordered_fold(a, ["stream_id"], ["kind", *order], lambda: _Stream(there), _append(scheme.text), _ADMITTED)


def config_matches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether a repeated create asks for what is there: type, fork source and place, expiry unless inherited, closed."""
    no, zero = F.lit(False), F.lit(0)
    inherits = b["forked_from"].isNotNull() & b["ttl_seconds"].isNull() & b["expires_at"].isNull()
    return (
        media.media_matches(a["content_type"], b["content_type"])
        & a["forked_from"].eqNullSafe(b["forked_from"])
        & (b["fork_offset"].isNull() | a["fork_offset"].eqNullSafe(b["fork_offset"]))
        & (F.coalesce(a["fork_sub_offset"], zero) == F.coalesce(b["fork_sub_offset"], zero))
        & (inherits | (a["ttl_seconds"].eqNullSafe(b["ttl_seconds"]) & a["expires_at"].eqNullSafe(b["expires_at"])))
        & (F.coalesce(a["closed"], no) == F.coalesce(b["closed"], no))
    )


def admit_creates(requests: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """First request per stream creates; later ones exist where all fields agree, else conflict."""
    w = Window.partitionBy("stream_id").orderBy(*order)
    first = requests.withColumn("place", F.row_number().over(w))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.first(f).over(w))
    return first.withColumn("status", F.when(F.col("place") == 1, "created").when(same, "exists").otherwise("conflict")).drop("place")


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)
