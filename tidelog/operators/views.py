"""Views over folded state, and their deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(n)


def view_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """enter, update and exit between two states of a view, with the old value."""
    b, a = before.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("b_")), after.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("a_"))
    kind = F.when(F.col("b_").isNull(), "enter").when(F.col("a_").isNull(), "exit").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    return b.join(a, keys, "full_outer").withColumn("delta", kind).where("delta is not null").select(*keys, "delta", "old_value", "new_value")


def classify(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """insert, update or unchanged, against the key's previous row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("delta", F.when(first, "insert").when(F.lag(value).over(w).eqNullSafe(F.col(value)), "unchanged").otherwise("update"))


def ordered_children(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Children per parent as one ordered array; fields come in sort order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def missing_parents(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    p = parents.select(F.col(parent_key).alias("p_"))
    return children.join(p, F.col(key) == F.col("p_"), "left_anti")


def changed(stored: DataFrame, fetched: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fetched rows that are new or differ from what is stored."""
    s = stored.select(*keys, F.struct(*fields).alias("s_"))
    return fetched.join(s, keys, "left").where(~F.struct(*fields).eqNullSafe(F.col("s_"))).drop("s_")


def poll(listed: DataFrame, stored: DataFrame, items: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One poll of a newest list: unseen ids are fetched, known ones refreshed; dead, deleted, untitled items and others than stories are left out.

    listed: key. items: key, type, title, time, dead, deleted and fields. Returns kept items with phase (new or
    refreshed) and changed (new, or different from what is stored).
    """
    usable = "not coalesce(deleted, false) and not coalesce(dead, false) and type = 'story' and coalesce(title, '') <> '' and coalesce(time, 0) <> 0"
    old = stored.select(F.col(key).alias("k_"), F.struct(*fields).alias("s_"))
    wanted = listed.select(key).unionByName(stored.select(key)).distinct()
    got = items.where(usable).join(wanted, key, "left_semi").join(old, F.col(key) == F.col("k_"), "left")
    phase = F.when(F.col("k_").isNull(), "new").otherwise("refreshed")
    return got.select(key, *fields, phase.alias("phase"), (~F.struct(*fields).eqNullSafe(F.col("s_"))).alias("changed"))


def poll_stats(polled: DataFrame) -> DataFrame:
    """Counts of a poll in one row."""
    count = lambda test: F.count(F.when(test, 1))
    return polled.agg(count(F.col("phase") == "new").alias("fetched_new"), count(F.col("phase") == "refreshed").alias("refreshed"), count(F.col("changed")).alias("changed"))


def first_ids(df: DataFrame, order: list[Column], key: str, n: int) -> DataFrame:
    """The first n ids of a list."""
    return df.orderBy(*order).select(key).limit(n)
