"""A log on shared storage: records, messages and producer states as versions that are committed as a whole.

A version is a small manifest that names the folders of its tables. It is made by creating the next manifest file, which
only one writer can do, so a commit either stands with its messages, records and producers together or has no effect.
A writer that loses builds its plan anew on the version that won; after ATTEMPTS losses its requests are busy (with an
expected offset: in conflict). Each operation takes a batch of requests. Messages are only ever added; a purged stream's
messages are no longer seen, because a message counts only for the incarnation of its stream that wrote it.

Storage is reached through Spark and Hadoop's file systems alone, so any shared folder that Spark can write will do.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import media, offsets
from tidelog.operators import admit, create, expiry, lineage, scan

ATTEMPTS = 8
#: How long a writer waits for another's commit before it takes that one for dead.
STALE_S = 30
RECORD = f"{create.RECORD}, incarnation long"
MESSAGE = "stream_id string, incarnation long, offset string, timestamp long, data binary"
PRODUCER = "stream_id string, producer_id string, epoch long, last_seq long"
_CAPABILITIES = frozenset({"create", "append", "fork", "delete", "expire", "touch", "read"})


class NotSupported(NotImplementedError):
    """An operation that this log was opened without."""


class Snapshot:
    """One version of the log."""

    def __init__(self, spark: SparkSession, version: int, tables: dict):
        self.spark, self.version, self.tables = spark, version, tables
        self.records = self._table("records", RECORD)
        self.producers = self._table("producers", PRODUCER)
        self.stored = self._table("messages", MESSAGE)

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = self.tables[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def messages(self) -> DataFrame:
        """Messages of the streams that are there, in their present incarnation."""
        return self.stored.join(self.records.select("stream_id", "incarnation"), ["stream_id", "incarnation"], "left_semi").drop("incarnation")


class LogStore:
    """A log under a folder. Clocks are arguments (now_ms); offsets: a scheme; policy: what counts as a dependent on delete."""

    def __init__(self, spark: SparkSession, folder: str, scheme=None, policy: str = "reverse-index", capabilities: frozenset = _CAPABILITIES):
        self.spark, self.folder, self.policy, self.capabilities = spark, folder.rstrip("/"), policy, capabilities
        self.scheme = offsets.checked(scheme or offsets.DefaultOffsets())
        self.hooks: list[Callable[[DataFrame], None]] = []
        self.wake = threading.Condition()
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self._fs.mkdirs(self._path(f"{self.folder}/versions"))

    # -- versions ------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The largest committed version; 0 for a new log."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/versions"))]
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def snapshot(self, version: int | None = None) -> Snapshot:
        v = self.version() if version is None else version
        tables = {"records": [], "producers": [], "messages": []}
        if v:
            stream = self._fs.open(self._path(f"{self.folder}/versions/{v:020d}.json"))
            tables = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return Snapshot(self.spark, v, tables)

    def _put(self, version: int, tables: dict) -> bool:
        """Create a version's manifest; False if another writer has. It appears whole: written aside, then renamed onto a free name."""
        aside, name = self._path(f"{self.folder}/versions/{uuid.uuid4().hex}.tmp"), self._path(f"{self.folder}/versions/{version:020d}.json")
        lock = self._path(f"{self.folder}/versions/{version:020d}.lock")
        try:
            self._fs.create(lock, False).close()  # only one writer makes it
        except Exception:  # noqa: BLE001
            if not self._fs.exists(lock):
                raise
            return False
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        try:
            self._context.rename(aside, name, self._no_overwrite)
        except Exception:  # noqa: BLE001
            if not self._fs.exists(name):
                raise
            return False  # the lock was taken for a dead writer's
        return True

    def _await_winner(self, version: int) -> None:
        """Wait for the manifest of a version that another writer is making; if it has died, free the version."""
        end = time.monotonic() + STALE_S
        while self.version() < version:
            if time.monotonic() > end:
                self._fs.delete(self._path(f"{self.folder}/versions/{version:020d}.lock"), False)
                return
            time.sleep(0.02)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        return path

    def _commit(self, plan: Callable[[Snapshot, int], tuple], replace: bool = False) -> DataFrame:
        """plan(snapshot, next version) gives (answers, records, producers or None, messages or None).

        replace: the messages stand for all that were there.
        """
        for _ in range(ATTEMPTS):
            snap = self.snapshot()
            answers, records, producers, messages = plan(snap, snap.version + 1)
            path = self._write(answers, "answers")
            answers = self.spark.read.schema(answers.schema).parquet(path)
            tables = dict(snap.tables)
            tables["records"] = [self._write(records.select(*[x.split()[0] for x in RECORD.split(", ")]), "records")]
            if producers is not None:
                tables["producers"] = [self._write(producers, "producers")]
            if messages is not None:
                tables["messages"] = [*([] if replace else tables["messages"]), self._write(messages.repartitionByRange("stream_id", "offset").sortWithinPartitions("stream_id", "offset"), "messages")]
            if self._put(snap.version + 1, tables):
                self._committed(snap.version + 1, answers)
                return answers
            self._await_winner(snap.version + 1)
        lost = F.when(F.col("expected_offset").isNotNull(), "conflict:expected-offset").otherwise("busy") if "expected_offset" in answers.columns else F.lit("busy")
        return answers.withColumn("status", lost)

    # -- hooks and waiting ---------------------------------------------------------------------------------------

    def on_commit(self, hook: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Call hook(commits) after every create, append or fork that changed something; returns how to take it off again."""
        self.hooks.append(hook)
        return lambda: self.hooks.remove(hook) if hook in self.hooks else None

    def _committed(self, version: int, answers: DataFrame) -> None:
        changed = answers.where("changed") if "changed" in answers.columns else None
        with self.wake:
            self.wake.notify_all()
        if changed is None or not self.hooks:
            return
        records = self.snapshot(version).records
        events = records.join(changed.select("stream_id").distinct(), "stream_id").select("stream_id", F.col("current_offset").alias("offset"), F.coalesce("closed", F.lit(False)).alias("closed"), F.coalesce("soft_deleted", F.lit(False)).alias("soft_deleted"))
        for hook in list(self.hooks):
            try:
                hook(events)
            except Exception:  # noqa: BLE001, S112
                continue  # a hook's failure is its own

    def await_change(self, seen_version: int, timeout_ms: int, park_ms: int = 1000, abort: threading.Event | None = None) -> str:
        """Wait for a version after seen_version: changed or timeout. The state is read before each wait, so no wake is lost; an abort looks like a timeout."""
        end = time.monotonic() + timeout_ms / 1000
        while True:
            if self.version() > seen_version:
                return "changed"
            left = end - time.monotonic()
            if left <= 0 or (abort is not None and abort.is_set()):
                return "timeout"
            with self.wake:
                self.wake.wait(min(left, park_ms / 1000))

    def _may(self, what: str) -> None:
        if what not in self.capabilities:
            raise NotSupported(what)

    # -- operations ----------------------------------------------------------------------------------------------

    def _fresh(self, snap: Snapshot, now_ms: int) -> tuple[DataFrame, DataFrame]:
        """Records after lazy expiry, and those that it purged."""
        over = snap.records.where(expiry.expired(F.col("expires_at_ms"), now_ms) & ~F.coalesce("soft_deleted", F.lit(False)))
        if over.isEmpty():
            return snap.records, snap.records.limit(0)
        return self._deleted(snap.records, over.select("stream_id"))

    def _deleted(self, records: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Records after deleting ids, upward to a fixpoint, and the purged ones."""
        if self.policy in ("ref-count", "reverse-index"):
            got = lineage.cascade(records, ids)
        else:  # forks hold a copy, or nothing is reclaimed before its time
            d = ids.select(F.col("stream_id").alias("d_")).distinct()
            hit = F.col("d_").isNotNull()
            keep = F.lit(self.policy == "ttl-only")
            got = records.join(d, F.col("stream_id") == F.col("d_"), "left").withColumn("status", F.when(hit & ~keep, "purged").otherwise("visible"))
            got = got.withColumn("soft_deleted", F.coalesce("soft_deleted", F.lit(False)) | (hit & keep)).drop("d_")
        return got.where("status <> 'purged'").drop("status"), got.where("status = 'purged'").drop("status")

    def create(self, requests: DataFrame, now_ms: int) -> DataFrame:
        """Creates and forks: stream_id, arrival, content_type, ttl_seconds, expires_at, closed, body, forked_from, fork_offset, fork_sub_offset."""
        self._may("create")

        def plan(snap: Snapshot, version: int):
            records, purged = self._fresh(snap, now_ms)
            decided, messages = create.plan(requests, records, now_ms, self.scheme, snap.messages)
            made = decided.where("status = 'created'").select(*[F.col(x.split()[0]) for x in create.RECORD.split(", ")]).withColumn("incarnation", F.lit(version).cast("long"))
            answers = decided.select("stream_id", "arrival", "status", "next_offset", (F.col("status") == "created").alias("changed"))
            producers = snap.producers.join(purged.select("stream_id"), "stream_id", "left_anti")
            return answers, records.unionByName(made), producers, messages.withColumn("incarnation", F.lit(version).cast("long"))

        return self._commit(plan)

    def append(self, attempts: DataFrame, now_ms: int) -> DataFrame:
        """Appends: stream_id, arrival, body, content_type, seq, producer_id, producer_epoch, producer_seq, close, expected_offset."""
        self._may("append")

        def plan(snap: Snapshot, version: int):
            records, purged = self._fresh(snap, now_ms)
            known = records.select(F.col("stream_id").alias("r_"), F.col("content_type").alias("have_type"), "incarnation")
            a = attempts.join(known, F.col("stream_id") == F.col("r_"), "left")
            a = a.withColumn("items_", create.framed_bytes(F.col("body"), F.col("have_type"))).withColumn("has_body", F.coalesce(F.octet_length("body") > 0, F.lit(False)))
            a = a.withColumn("n_messages", F.when(F.col("items_").isNotNull(), F.size("items_")).cast("long")).withColumn("type_ok", F.coalesce(media.media_matches(F.col("content_type"), F.col("have_type")), F.lit(False)))
            got = admit.admit_appends(a, ["arrival"], records, snap.producers.join(purged.select("stream_id"), "stream_id", "left_anti"), self.scheme)
            path = self._write(got, "admitted")
            got = self.spark.read.schema(got.schema).parquet(path)
            answers = got.join(attempts.select("stream_id", "arrival", "expected_offset"), ["stream_id", "arrival"]).select(
                "stream_id", "arrival", "status", "before", F.col("tail").alias("next_offset"), "closed", "changed", "expected_offset"
            )
            done = got.where("changed")
            last = done.groupBy(F.col("stream_id").alias("l_")).agg(F.max_by(F.struct("tail", "closed", "last_seq"), "arrival").alias("now_"))
            r = records.join(last, F.col("stream_id") == F.col("l_"), "left")
            hit = F.col("l_").isNotNull()
            newly = hit & F.col("now_.closed") & ~F.coalesce("closed", F.lit(False))
            r = r.withColumn("current_offset", F.coalesce("now_.tail", "current_offset")).withColumn("last_seq", F.coalesce("now_.last_seq", "last_seq")).withColumn("closed_at", F.when(newly, now_ms).otherwise(F.col("closed_at")))
            r = r.withColumn("closed", F.coalesce("now_.closed", "closed")).withColumn("expires_at_ms", F.when(hit & F.col("ttl_seconds").isNotNull(), now_ms + F.col("ttl_seconds") * 1000).otherwise(F.col("expires_at_ms"))).drop("l_", "now_")
            p = done.where("producer_id is not null").groupBy("stream_id", "producer_id").agg(F.max_by(F.struct("epoch", "producer_seq"), "arrival").alias("s"))
            p = p.select("stream_id", "producer_id", "s.epoch", F.col("s.producer_seq").alias("last_seq"))
            kept = snap.producers.join(purged.select("stream_id"), "stream_id", "left_anti")
            accepted = a.select("stream_id", "arrival", "items_", "incarnation").join(done.select("stream_id", "arrival", "before"), ["stream_id", "arrival"])
            m = create.messages_of(accepted, "items_", "before", now_ms, self.scheme).join(known.select(F.col("r_").alias("stream_id"), "incarnation"), "stream_id")
            return answers, r, admit.upsert(kept, p, ["stream_id", "producer_id"]), m

        return self._commit(plan)

    def delete(self, ids: DataFrame, now_ms: int) -> DataFrame:
        """Delete streams (stream_id): purged, retained-soft-deleted, gone or not-found, each as of before the batch."""
        self._may("delete")

        def plan(snap: Snapshot, version: int):
            records, _ = self._fresh(snap, now_ms)
            left, purged = self._deleted(records, ids)
            was = records.select(F.col("stream_id").alias("w_"), F.coalesce("soft_deleted", F.lit(False)).alias("was_"))
            now = purged.select(F.col("stream_id").alias("n_"))
            got = ids.select("stream_id").distinct().join(was, F.col("stream_id") == F.col("w_"), "left").join(now, F.col("stream_id") == F.col("n_"), "left")
            status = F.when(F.col("w_").isNull(), "not-found").when(F.col("was_"), "gone").when(F.col("n_").isNotNull(), "purged").otherwise("retained-soft-deleted")
            producers = snap.producers.join(purged.select("stream_id"), "stream_id", "left_anti")
            return got.select("stream_id", status.alias("status")), left, producers, None

        return self._commit(plan)

    def expire(self, now_ms: int) -> DataFrame:
        """Delete all streams whose time has come: (stream_id, status)."""
        self._may("expire")
        snap = self.snapshot()
        over = snap.records.where(expiry.expired(F.col("expires_at_ms"), now_ms) & ~F.coalesce("soft_deleted", F.lit(False))).select("stream_id")

        def plan(snap: Snapshot, version: int):
            left, purged = self._deleted(snap.records, over)
            got = over.join(purged.select(F.col("stream_id").alias("n_")), F.col("stream_id") == F.col("n_"), "left")
            status = F.when(F.col("n_").isNotNull(), "purged").otherwise("retained-soft-deleted")
            return got.select("stream_id", status.alias("status")), left, snap.producers.join(purged.select("stream_id"), "stream_id", "left_anti"), None

        return self._commit(plan)

    def compact(self) -> None:
        """Write the messages of present streams into one folder; what purged streams left behind is no longer named."""
        self._may("delete")

        def plan(snap: Snapshot, version: int):
            kept = snap.stored.join(snap.records.select("stream_id", "incarnation"), ["stream_id", "incarnation"], "left_semi")
            return snap.records.select("stream_id").limit(0), snap.records, None, kept

        self._commit(plan, replace=True)

    def touch(self, reads: DataFrame, now_ms: int) -> DataFrame:
        """Slide the expiry of streams that were read (stream_id, at_ms, reason)."""
        self._may("touch")
        return self._commit(lambda snap, version: (reads, expiry.touch(self._fresh(snap, now_ms)[0], reads), None, None))

    def read(self, requests: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
        """Catch-up reads (stream_id, from) through forks: (answers, messages after the place in order of stream and offset)."""
        self._may("read")
        snap = self.snapshot()
        records, _ = self._fresh(snap, now_ms)
        asked = records.join(requests.select("stream_id").distinct(), "stream_id", "left_semi").where("not coalesce(soft_deleted, false)")
        seen = lineage.chain_read(snap.messages, asked, others=records)
        q = requests.select(F.col("stream_id").alias("q_"), "from", offsets.read_start(F.col("from")).alias("after_"))
        m = seen.join(q, F.col("stream_id") == F.col("q_")).where(F.col("after_").isNull() | (F.col("offset") > F.col("after_")))
        count = m.groupBy("stream_id", "from").agg(F.count("*").alias("n_messages"), F.max("offset").alias("last"))
        got = requests.select("stream_id", "from").join(records.select("stream_id", "current_offset", "closed", "soft_deleted"), "stream_id", "left").alias("a").join(count.alias("c"), (F.col("a.stream_id") == F.col("c.stream_id")) & F.col("a.from").eqNullSafe(F.col("c.from")), "left")
        status = scan.visibility(F.col("current_offset").isNotNull(), F.col("soft_deleted"))
        ok = status == "visible"
        nxt = F.greatest(F.coalesce("last", "current_offset"), "current_offset")
        answers = got.select(
            "a.stream_id", "a.from", F.when(ok, "ok").otherwise(status).alias("status"), F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.when(ok, nxt).alias("next_offset"),
            F.when(ok, F.coalesce("closed", F.lit(False)) & (nxt == F.col("current_offset"))).alias("closed"),
        )
        return answers, m.select("stream_id", "from", "offset", "timestamp", "data").orderBy("stream_id", "offset")


def fan_in(events: DataFrame, stream_id: str, target: str) -> DataFrame:
    """Append attempts that put commit events of one stream into another, as JSON."""
    own = events.where((F.col("stream_id") == stream_id) & (F.col("offset") != offsets.ZERO))
    null = lambda t: F.lit(None).cast(t)
    return own.select(
        F.lit(target).alias("stream_id"), F.monotonically_increasing_id().alias("arrival"), F.to_json(F.struct("stream_id", "offset", "closed", "soft_deleted")).cast("binary").alias("body"), F.lit("application/json").alias("content_type"),
        null("string").alias("seq"), null("string").alias("producer_id"), null("long").alias("producer_epoch"), null("long").alias("producer_seq"), F.lit(False).alias("close"), null("string").alias("expected_offset"),
    )


class CheckpointStore:
    """Checkpoints of views as JSON messages of a stream each: saved by append, loaded as the last one; malformed content fails."""

    SCHEMA = "cursors map<string,string>, applied_through string, snapshot string"

    def __init__(self, log: LogStore):
        self.log = log

    def _ids(self, views: DataFrame) -> DataFrame:
        return views.withColumn("stream_id", media.checkpoint_stream(F.col("view_id")))

    def save(self, checkpoints: DataFrame, now_ms: int) -> DataFrame:
        """checkpoints: view_id, cursors, applied_through, snapshot. Streams are made where they are missing."""
        c = self._ids(checkpoints)
        null = lambda t: F.lit(None).cast(t)
        body = F.to_json(F.struct("cursors", "applied_through", "snapshot")).cast("binary")
        self.log.create(c.select("stream_id", F.lit(0).cast("long").alias("arrival"), F.lit("application/json").alias("content_type"), null("long").alias("ttl_seconds"), null("string").alias("expires_at"), F.lit(False).alias("closed"), null("binary").alias("body"), null("string").alias("forked_from"), null("string").alias("fork_offset"), null("long").alias("fork_sub_offset")), now_ms)
        a = c.select("stream_id", F.lit(0).cast("long").alias("arrival"), body.alias("body"), F.lit("application/json").alias("content_type"), null("string").alias("seq"), null("string").alias("producer_id"), null("long").alias("producer_epoch"), null("long").alias("producer_seq"), F.lit(False).alias("close"), null("string").alias("expected_offset"))
        return self.log.append(a, now_ms)

    def load(self, views: DataFrame) -> DataFrame:
        """(view_id, cursors, applied_through, snapshot); views without a checkpoint are left out, malformed content raises."""
        return load_checkpoints(self.log.snapshot().messages.join(self._ids(views), "stream_id"), ["view_id"])


def load_checkpoints(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The last checkpoint of each key. Every message is decoded, and one that is malformed fails the load when it is run."""
    text = F.col("data").cast("string")
    got = F.from_json(text, f"{CheckpointStore.SCHEMA}, bad_ string", {"columnNameOfCorruptRecord": "bad_"})
    sound = F.json_object_keys(text).isNotNull() & got["bad_"].isNull() & got["cursors"].isNotNull()
    value = F.when(sound, got).otherwise(F.raise_error(F.lit("malformed checkpoint")).cast("struct<cursors:map<string,string>,applied_through:string,snapshot:string,bad_:string>"))
    last = messages.select(*keys, "offset", value.alias("c")).groupBy(*keys).agg(F.max_by("c", "offset").alias("c"))
    return last.select(*keys, "c.cursors", "c.applied_through", "c.snapshot")
