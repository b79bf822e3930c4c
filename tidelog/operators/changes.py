"""Change logs: validation, builders, folding into keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.scalars import has_key

OPERATIONS = ("insert", "update", "delete")
CONTROLS = ("snapshot-start", "snapshot-end", "reset")


def validate(message: Column, types: list[str]) -> Column:
    """Label of the first rule a change message (JSON text) breaks; null for a valid one."""
    path = lambda p: F.get_json_object(message, p)
    headers = path("$.headers")
    keys = F.json_object_keys(message)
    op, control = path("$.headers.operation"), path("$.headers.control")
    is_object = lambda x: F.coalesce(F.json_object_keys(x).isNotNull(), F.lit(False))
    no_value = ~has_key(message, "value") | (path("$.value").isNull())
    text = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(message), f"$.{k}", "variant")) == "STRING"
    named = lambda k: F.coalesce(text(k) & (path(f"$.{k}") != ""), F.lit(False))
    return (
        F.when(keys.isNull(), "not-an-object")
        .when(~is_object(headers), "headers")
        .when(has_key(headers, "control") & ~control.isin(*CONTROLS), "control")
        .when(has_key(headers, "control") & (has_key(message, "type") | has_key(message, "key")), "control-with-key")
        .when(has_key(headers, "control"), None)
        .when(~named("type"), "type")
        .when(~named("key"), "key")
        .when(op.isNull() | ~op.isin(*OPERATIONS), "operation")
        .when(~path("$.type").isin(*types), "unknown-type")
        .when((op != "delete") & ~has_key(message, "value"), "value-missing")
        .when((op == "delete") & ~no_value, "value-on-delete")
    )


def change(kind: Column, key: Column, operation: str, value: Column | None = None, old_value: Column | None = None, txid: Column | None = None) -> Column:
    """JSON text of a change; operation comes last in the headers, absent parts are left out."""
    if operation not in OPERATIONS:
        raise ValueError(operation)
    q = lambda c: F.to_json(c.cast("variant"))
    part = lambda name, c: F.lit("") if c is None else F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c)).otherwise("")
    tx = F.lit("") if txid is None else F.when(txid.isNotNull(), F.concat(F.lit('"txid":'), q(txid), F.lit(","))).otherwise("")
    return F.concat(F.lit('{"type":'), q(kind), F.lit(',"key":'), q(key), part("value", None if operation == "delete" else value), part("old_value", old_value), F.lit(',"headers":{'), tx, F.lit(f'"operation":"{operation}"}}}}'))


def control(name: str, offset: Column | None = None) -> Column:
    if name not in CONTROLS:
        raise ValueError(name)
    at = F.lit("") if offset is None else F.when(offset.isNotNull(), F.concat(F.lit(',"offset":"'), offset, F.lit('"'))).otherwise("")
    return F.concat(F.lit(f'{{"headers":{{"control":"{name}"'), at, F.lit("}}"))


def route(changes: DataFrame, types: dict[str, str]) -> DataFrame:
    """Changes with the collection their type belongs to; other types have none."""
    of = F.lit(None).cast("string")
    for name, wire in types.items():
        of = F.when(F.col("type") == wire, F.lit(name)).otherwise(of)
    return changes.withColumn("collection", of)


def upsert_fold(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows of a log that also has upserts (insert or update, whichever it is)."""
    c = changes.withColumn("operation", F.when(F.col("operation") == "upsert", "update").otherwise(F.col("operation")))
    return latest_state(c, keys)


def keyed_writes(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the operation a keyed collection writes for them: insert for a new key, else update."""
    k = known.select(*keys, F.lit(True).alias("known_")).dropDuplicates(keys)
    return rows.join(k, keys, "left").withColumn("operation", F.when(F.col("known_").isNull(), "insert").otherwise("update")).drop("known_")


def update_from_previous(previous: dict[str, Column], patch: dict[str, Column]) -> dict[str, Column]:
    """A row's next fields: what the patch has, else what was there."""
    return {name: F.coalesce(patch[name], old) if name in patch else old for name, old in previous.items()}


def mutate(requests: DataFrame, order: list[str], initial, attempt, schema: str) -> DataFrame:
    """Optimistic mutations of a state per key, as one serial fold: each request is validated against exactly the state it lands on.

    attempt(state, row) returns the new state (None: nothing is written) and the answer. Writers that race on a stored log
    go through LogStore.append with an expected offset instead, and retry.
    """
    from tidelog.operators.fold import ordered_fold

    def step(state, row):
        new, answer = attempt(state, row)
        return (state if new is None else new), answer

    return ordered_fold(requests, [requests.columns[0]], order, initial, step, schema)


def latest_state(changes: DataFrame, keys: list[str], until: str | None = None) -> DataFrame:
    """Live rows: the last change per key unless it deletes. A map-side combinable max_by; tombstones survive it."""
    c = changes if until is None else changes.where(F.col("offset") <= until)
    last = c.groupBy(*keys).agg(F.max_by(F.struct("operation", "value", "offset"), "offset").alias("c"))
    return last.where("c.operation <> 'delete'").select(*keys, "c.value", "c.offset")


def after_reset(changes: DataFrame, scope: list[str]) -> DataFrame:
    """Changes after the last reset of their scope; control rows are dropped."""
    resets = changes.where("control = 'reset'").groupBy(*scope).agg(F.max("offset").alias("reset_"))
    got = changes.where("control is null").join(resets, scope, "left")
    return got.where(F.col("reset_").isNull() | (F.col("offset") > F.col("reset_"))).drop("reset_")


def after_snapshot(changes: DataFrame, scope: list[str]) -> DataFrame:
    """A finished snapshot (start followed by end) replaces everything before its start; an open one replaces nothing yet."""
    w = Window.partitionBy(*scope).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    marks = changes.where("control in ('snapshot-start', 'snapshot-end')").withColumn("start_", F.max(F.when(F.col("control") == "snapshot-start", F.col("offset"))).over(w))
    done = marks.where("control = 'snapshot-end' and start_ is not null").groupBy(*scope).agg(F.max("start_").alias("from_"))
    got = changes.where("control is null").join(done, scope, "left")
    return got.where(F.col("from_").isNull() | (F.col("offset") > F.col("from_"))).drop("from_")
