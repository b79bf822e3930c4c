"""Streaming twins of the batch operators. Every query keeps its checkpoint under the given path and can be resumed."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.operators.admit import producer_decision
from tidelog.operators.fold import sum_fold
from tidelog.operators.views import top_n, view_delta


def _drain(writer, path: str) -> None:
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


class KeyedTable:
    """The latest row of every key, kept as Parquet in buckets by key; a batch rewrites only the buckets that it touches.

    A batch writes under its own number and reads its predecessor's owners (which batch wrote a bucket last), so a repeated
    batch gives the same files. Rows compare by `order`; further columns go along.
    """

    def __init__(self, spark, path: str, schema, keys: list[str], order: str, buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path, schema, keys, order, buckets

    def owners(self, number: int) -> dict[int, int]:
        if number < 0:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/owners/{number}").collect()}

    def rows(self, owners: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        """Rows of all buckets, or of some, with their bucket."""
        by: dict[int, list[int]] = {}
        for bucket, batch in owners.items():
            if buckets is None or bucket in buckets:
                by.setdefault(batch, []).append(bucket)
        got = [self.spark.read.schema(self.schema).parquet(*[f"{self.path}/state/{n}/bucket={k}" for k in ks]) for n, ks in sorted(by.items())]
        return reduce(DataFrame.unionByName, got) if got else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> tuple[dict[int, int], list[int]]:
        """Merge a batch; the owners after it, and the buckets that it touched (at most `buckets`)."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        before = self.owners(number - 1)
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]
        every = self.rows(before, touched).unionByName(batch)
        rest = [f.name for f in self.schema if f.name not in self.keys]
        new = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order).alias("r")).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        if touched:
            new.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/{number}")
        after = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(list(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/owners/{number}")
        return after, touched


def latest_state(changes: DataFrame, keys: list[str], order, path: str) -> DataFrame:
    """Live rows per key after all that has arrived (a mirror of the log); state is one row per key, merged in place."""
    spark = changes.sparkSession
    got = changes.select(*keys, "operation", "value", F.col(order).alias("order_"))
    table, last = KeyedTable(spark, f"{path}/keyed", got.schema, keys, "order_"), [-1]

    def fold(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        last[0] = number

    _drain(got.writeStream.foreachBatch(fold), path)
    return table.rows(table.owners(last[0])).where("operation <> 'delete'").select(*keys, "value")


def producer_admission(attempts: DataFrame, path: str) -> DataFrame:
    """Exactly-once producers: the state (epoch, last sequence) is kept per stream and producer."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        status = []
        for epoch, seq in zip(rows["producer_epoch"], rows["producer_seq"], strict=True):
            got = producer_decision(held, int(epoch), int(seq))
            if got == "accepted":
                held = (int(epoch), int(seq))
            status.append(got)
        if held:
            state.update(held)
        yield pd.DataFrame({"stream_id": key[0], "event_id": rows["event_id"], "status": status})

    got = attempts.groupBy("stream_id", "producer_id").applyInPandasWithState(step, "stream_id string, event_id long, status string", "epoch long, last_seq long", "append", GroupStateTimeout.NoTimeout)
    _drain(got.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), path)
    return attempts.sparkSession.read.schema("stream_id string, event_id long, status string").parquet(f"{path}/out")


def top_n_deltas(rows: DataFrame, keys: list[str], value: str, order: list, n: int, path: str, arrival: str | None = None) -> DataFrame:
    """enter, update and exit rows per micro-batch for a top-n view over the latest row of every key.

    arrival: the column by which a key's rows follow each other (without it keys never come again). A column `operation`
    with `delete` takes a key out; what was below the view then moves up. Each bucket of the keyed state keeps its own top n,
    so a batch looks at the buckets it touches and at n rows of each other one.
    """
    spark = rows.sparkSession
    at = rows.withColumn("order_", F.col(arrival) if arrival else F.lit(0))
    schema = at.schema
    table = KeyedTable(spark, f"{path}/keyed", schema, keys, "order_")
    tops = KeyedTable(spark, f"{path}/tops", schema, keys, "order_")
    live = F.col("operation") != "delete" if "operation" in rows.columns else F.lit(True)

    def fold(batch: DataFrame, number: int) -> None:
        owners, touched = table.merge(batch, number)
        # the top n of each touched bucket, written beside the state
        best = tops.owners(number - 1)
        if touched:
            mine = table.rows(owners, touched).where(live).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(table.buckets)).cast("int"))
            w = Window.partitionBy("bucket").orderBy(*order)
            mine.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tops/state/{number}")
            there = {r["bucket"] for r in mine.select("bucket").distinct().collect()}
            best = {k: v for k, v in best.items() if k not in touched} | dict.fromkeys(there, number)
        spark.createDataFrame(list(best.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/tops/owners/{number}")
        top_n(tops.rows(best), order, n).write.mode("overwrite").parquet(f"{path}/view/{number}")
        before = spark.read.schema(schema).parquet(f"{path}/view/{number - 1}") if number else spark.createDataFrame([], schema)
        after = spark.read.schema(schema).parquet(f"{path}/view/{number}")
        view_delta(before, after, keys, value).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/delta/{number}")

    _drain(at.writeStream.foreachBatch(fold), path)
    return spark.read.parquet(f"{path}/delta/*")


def checkpointed_fold(events: DataFrame, key: str, value: str, order: str, path: str, observer=None) -> DataFrame:
    """A sum per key with its cursor, folded batch by batch and resumed where it stopped; a replayed batch changes nothing.

    observer(before, after, number): called with the states of the keys that a batch touched.
    """
    spark = events.sparkSession
    schema = "k_ string, state long, cursor string"

    def fold(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{path}/fold/{number - 1}") if number else spark.createDataFrame([], schema)
        old = before.withColumnRenamed("k_", key)
        new = sum_fold(batch.select(key, F.col(value).alias("value_"), F.col(order).alias("offset")), "value_", old, key)
        new.select(F.col(key).alias("k_"), "state", "cursor").write.mode("overwrite").parquet(f"{path}/fold/{number}")
        spark.createDataFrame([(number,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/last")
        if observer is not None:
            hit = batch.select(F.col(key).alias("k_")).distinct()
            observer(before.join(hit, "k_", "left_semi"), spark.read.schema(schema).parquet(f"{path}/fold/{number}").join(hit, "k_", "left_semi"), number)

    _drain(events.writeStream.foreachBatch(fold), path)
    number = spark.read.schema("n long").parquet(f"{path}/last").first()["n"]
    return spark.read.schema(schema).parquet(f"{path}/fold/{number}").withColumnRenamed("k_", key)


class ReadSession:
    """Batches of a stream for one consumer, one at a time: the next micro-batch starts when the last one is taken.

    Iterate it once. done is running, done, cancelled or error; a cancelled session ends, it does not raise.
    """

    def __init__(self, rows: DataFrame, path: str, live: bool = False):
        self.offered, self.done, self.error, self._used, self._stop = queue.Queue(maxsize=1), "running", None, False, threading.Event()
        writer = rows.writeStream.foreachBatch(self._offer).option("checkpointLocation", f"{path}/checkpoint")
        self.query = (writer if live else writer.trigger(availableNow=True)).start()

    def _offer(self, batch: DataFrame, number: int) -> None:
        got = batch.collect()  # one micro-batch, bounded by the source's limit per trigger
        while not self._stop.is_set():
            try:
                self.offered.put((number, got), timeout=0.1)
                return
            except queue.Full:
                continue

    def __iter__(self):
        if self._used:
            raise RuntimeError("a session is read once")
        self._used = True
        while not self._stop.is_set():
            try:
                yield self.offered.get(timeout=0.1)
            except queue.Empty:
                if not self.query.isActive and self.offered.empty():
                    break
        if self.done == "running":
            failed = self.query.exception()
            self.done, self.error = ("error", failed) if failed else ("done", None)

    def cancel(self) -> None:
        if self.done == "running":
            self.done = "cancelled"
        self._stop.set()
        self.query.stop()


def windowed_counts(events: DataFrame, size: str, late: str, path: str) -> DataFrame:
    """Event-time counts with a watermark (an extension: the log itself orders by arrival only)."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").count()
    write = lambda batch, _: batch.select(F.col("window.start").alias("start"), "event_type", "count").write.mode("overwrite").parquet(f"{path}/view")
    _drain(got.writeStream.outputMode("complete").foreachBatch(write), path)
    return events.sparkSession.read.schema("start timestamp, event_type string, count long").parquet(f"{path}/view")
