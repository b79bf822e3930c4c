"""Folds over ordered logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], initial: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], schema: str) -> DataFrame:
    """A sequential fold per key with at most one output row per input row.

    Rows of a key stream through one task in order, batch by batch; only the fold's state is held, so a long key does
    not need to fit in memory. step(state, row) returns the new state and the output row, or None for none; rows are
    tuples in the order of df's columns, taken from whole Arrow columns at a time.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = [row[i] for i in at]
                if now != key:
                    key, state = now, initial()
                state, got = step(state, row)
                if got is not None:
                    out.append(got)
            cols = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def events(batch: DataFrame, decode: Column, keep: list[str]) -> DataFrame:
    """Events of messages: decode gives an array per message; a message may give none, one or many, in order."""
    return batch.select(*keep, F.posexplode(decode).alias("place", "event"))


def materialize(log: DataFrame, key: str, order: list[str], initial: Column, evolve, event: Column) -> DataFrame:
    """A user's fold (initial, evolve) per key over its ordered events, as an expression: (key, state).

    A key's events are gathered in one row, so this is for folds that no aggregate expresses over short logs; use
    ordered_fold for long ones.
    """
    got = log.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, event.alias("e")))).alias("log"))
    return got.select(key, F.aggregate(F.col("log.e"), initial, evolve).alias("state"))


def last_wins(df: DataFrame, keys: list[str], order: str = "offset") -> DataFrame:
    """The whole last row per key, by a map-side combinable aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys and c != order]
    top = F.max_by(F.struct(*rest), order).alias("r") if rest else F.lit(None).alias("r")
    got = df.groupBy(*keys).agg(F.max(order).alias(order), top)
    return got.select(*keys, order, *[F.col(f"r.{c}").alias(c) for c in rest])


def resume(events: DataFrame, cursors: DataFrame, key: str = "stream_id") -> DataFrame:
    """Events after each key's cursor; all events where there is no cursor."""
    c = cursors.select(F.col(key).alias("k_"), F.col("cursor").alias("cursor_"))
    return events.join(c, F.col(key) == F.col("k_"), "left").where(F.col("cursor_").isNull() | (F.col("offset") > F.col("cursor_"))).drop("k_", "cursor_")


def sum_fold(events: DataFrame, value: str, states: DataFrame | None = None, key: str = "stream_id") -> DataFrame:
    """Sum per key with cursor; states (key, state, cursor) are resumed, and kept where nothing is new."""
    new = events if states is None else resume(events, states, key)
    got = new.groupBy(key).agg(F.sum(value).alias("added"), F.max("offset").alias("at"))
    if states is None:
        return got.select(key, F.col("added").alias("state"), F.col("at").alias("cursor"))
    both = states.join(got, key, "full_outer")
    return both.select(key, (F.coalesce("state", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("state"), F.coalesce("at", "cursor").alias("cursor"))
