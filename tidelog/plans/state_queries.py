"""Queries of keyed state, views, polling and typed JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import admit, changes, fold, jsonlayer, lineage, scan, views
from tidelog.plans import fixtures as fx
from tidelog.plans.fixtures import CHANGES, MESSAGES, STREAMS, off_sql
from tidelog.plans.registry import query
from tidelog.sources.store import load_checkpoints
from tidelog.streaming import live


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'people' END AS collection FROM events""")
def wire_routing(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.col("event_type").alias("type"))
    return changes.route(e, {"orders": "purchase", "people": "signup"}).select("event_id", "collection")


@query(f"""WITH {STREAMS} SELECT 'user/'||c_custkey AS stream_id, content_type, current_offset FROM customer LEFT JOIN streams ON streams.user_id=c_custkey""")
def record_lookup(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("user/"), "c_custkey").alias("stream_id"))
    return scan.lookup(fx.streams(spark, d).select("stream_id", "content_type", "current_offset"), ids, ["stream_id"])


@query("""WITH p AS (SELECT user_id, event_type, max(event_id) AS last_seq FROM events GROUP BY ALL), k AS (SELECT c_custkey AS user_id, t.event_type FROM customer, (SELECT DISTINCT event_type FROM events) t)
 SELECT 'user/'||user_id AS stream_id, event_type AS producer_id, last_seq FROM k LEFT JOIN p USING (user_id, event_type)""")
def producer_lookup(spark, d):
    e = fx.table(spark, d, "events")
    states = e.groupBy(F.concat(F.lit("user/"), "user_id").alias("stream_id"), F.col("event_type").alias("producer_id")).agg(F.max("event_id").alias("last_seq"))
    kinds = e.agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))  # a handful of event types
    keys = fx.table(spark, d, "customer").select(F.concat(F.lit("user/"), "c_custkey").alias("stream_id"), F.explode(F.array(*[F.lit(x) for x in kinds.first()["kinds"]])).alias("producer_id"))
    return scan.lookup(states, keys, ["stream_id", "producer_id"])


@query(f"""WITH {MESSAGES}, {STREAMS} SELECT m.stream_id, m."offset", closed, soft_deleted FROM messages m JOIN streams USING (stream_id)""")
def commit_events(spark, d):
    return scan.commits(fx.messages(spark, d), fx.streams(spark, d))


@query(f"""WITH {STREAMS} SELECT c_custkey, coalesce(NOT soft_deleted AND current_offset>={off_sql("c_custkey%90")}, false) AS live FROM customer LEFT JOIN streams ON user_id=c_custkey""")
def source_liveness(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey")
    j = c.join(fx.streams(spark, d), F.col("c_custkey") == F.col("user_id"), "left")
    at = F.concat(F.lpad((F.col("c_custkey") % 90).cast("string"), 16, "0"), F.lit("_" + "0" * 16))
    return j.select("c_custkey", lineage.source_live(F.col("stream_id").isNotNull(), F.col("soft_deleted"), F.col("current_offset"), at).alias("live"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) AS has_projects FROM customer")
def has_projects(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return fx.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("has_projects"))


_ITEMS = """items AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%7=0 THEN 'job' ELSE 'story' END AS type, CASE WHEN o_orderkey%11=0 THEN '' ELSE o_orderpriority END AS title, o_orderkey+1 AS time,
 o_orderkey%13=0 AS dead, CASE WHEN o_orderkey%17=0 THEN true END AS deleted, o_orderkey%10 AS score FROM orders), listed AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus<>'P'),
 stored AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 THEN o_orderpriority ELSE 'old' END AS title, o_orderkey%10 AS score FROM orders WHERE o_orderstatus='P' OR o_orderkey%2=0),
 polled AS (SELECT i.id, i.title, i.score, CASE WHEN s.id IS NULL THEN 'new' ELSE 'refreshed' END AS phase, s.id IS NULL OR s.title<>i.title OR s.score<>i.score AS changed FROM items i LEFT JOIN stored s USING (id)
 WHERE (i.id IN (SELECT id FROM listed) OR s.id IS NOT NULL) AND NOT dead AND deleted IS NULL AND type='story' AND i.title<>'')"""


def _poll(spark, d):
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey")
    items = o.select(
        k.alias("id"), F.when(k % 7 == 0, "job").otherwise("story").alias("type"), F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), (k + 1).alias("time"), (k % 13 == 0).alias("dead"),
        F.when(k % 17 == 0, True).alias("deleted"), (k % 10).alias("score"),
    )
    listed = o.where("o_orderstatus <> 'P'").select(k.alias("id"))
    stored = o.where("o_orderstatus = 'P' or o_orderkey % 2 = 0").select(k.alias("id"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("old").alias("title"), (k % 10).alias("score"))
    return views.poll(listed, stored, items, "id", ["title", "score"])


@query(f"WITH {_ITEMS} SELECT id, title, score, phase, changed FROM polled")
def poll_newest(spark, d):
    return _poll(spark, d)


@query(f"WITH {_ITEMS} SELECT count(*) FILTER (WHERE phase='new') AS fetched_new, count(*) FILTER (WHERE phase<>'new') AS refreshed, count(*) FILTER (WHERE changed) AS changed FROM polled")
def poll_stats(spark, d):
    return views.poll_stats(_poll(spark, d))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def first_ids(spark, d):
    return views.first_ids(fx.table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], "event_id", 30)


@query("""SELECT c_custkey AS child, c_custkey//2 AS parent FROM customer WHERE c_custkey%5<>0""")
def child_edges(spark, d):
    c = fx.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("parent"), F.col("c_custkey").alias("child"))
    every, some = c.where("child % 2 = 0"), c.where("child % 3 <> 0")
    return lineage.child_edges(every, some.unionByName(c.where("child % 3 = 0")).unionByName(some), c.where("child % 5 = 0"))


@query("SELECT o_custkey AS k, CASE WHEN o_custkey%2=0 THEN -1 ELSE max(o_orderkey) END AS v FROM orders GROUP BY 1")
def insert_absent(spark, d):
    new = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return admit.insert_if_absent(new.where("k % 2 = 0").select("k", F.lit(-1).cast("long").alias("v")), new, ["k"])


@query("SELECT o_custkey AS k, CASE WHEN o_custkey%2=0 THEN max(o_orderkey) ELSE -1 END AS v FROM orders GROUP BY 1")
def upsert_rows(spark, d):
    new = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    return admit.upsert(new.select("k", F.lit(-1).cast("long").alias("v")), new.where("k % 2 = 0"), ["k"])


@query("SELECT o_orderkey, CASE WHEN o_custkey%3=0 THEN 'update' ELSE 'insert' END AS operation FROM orders")
def keyed_writes(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return changes.keyed_writes(o, o.where("o_custkey % 3 = 0"), ["o_custkey"]).select("o_orderkey", "operation")


# -- change messages -------------------------------------------------------------------------------------------------


@query("""SELECT event_id, '{"type":"story","key":"'||event_id||'"'||CASE WHEN event_id%2=0 THEN ',"value":'||props ELSE '' END||CASE WHEN event_id%3=0 THEN ',"old_value":'||props ELSE '' END||
 ',"headers":{"operation":"'||CASE WHEN event_id%2=0 THEN 'update' ELSE 'delete' END||'"}}' AS message, '{"headers":{"control":"'||CASE event_id%3 WHEN 0 THEN 'reset' WHEN 1 THEN 'snapshot-start' ELSE 'snapshot-end' END||'"'||
 CASE WHEN event_id%2=0 THEN ',"offset":"'||event_id||'"' ELSE '' END||'}}' AS control FROM events""")
def change_builders(spark, d):
    i, key = F.col("event_id"), F.col("event_id").cast("string")
    old = F.when(i % 3 == 0, F.col("props"))
    made = F.when(i % 2 == 0, changes.change(F.lit("story"), key, "update", F.col("props"), old)).otherwise(changes.change(F.lit("story"), key, "delete", F.col("props"), old))
    at = F.when(i % 2 == 0, key)
    mark = F.when(i % 3 == 0, changes.control("reset", at)).when(i % 3 == 1, changes.control("snapshot-start", at)).otherwise(changes.control("snapshot-end", at))
    return fx.table(spark, d, "events").select("event_id", made.alias("message"), mark.alias("control"))


@query(f"""WITH {CHANGES} SELECT scope, key, value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY "offset" DESC) AS k FROM changes WHERE control IS NULL) WHERE k=1 AND operation<>'delete'""")
def upsert_fold(spark, d):
    c = fx.changes(spark, d).where("control is null")
    return changes.upsert_fold(c.withColumn("operation", F.when(F.col("operation") == "delete", "delete").otherwise("upsert")), ["scope", "key"]).select("scope", "key", "value")


@query("""SELECT o_orderkey, o_custkey AS project, CASE WHEN o_orderkey%2=0 THEN trim(o_orderpriority) ELSE 'kept' END AS title, CASE WHEN o_orderkey%3=0 THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey%5=0 THEN o_orderkey ELSE 7 END AS updated FROM orders""")
def update_from_previous(spark, d):
    k = F.col("o_orderkey")
    before = {"project": F.col("o_custkey"), "title": F.lit("kept"), "status": F.lit("open"), "updated": F.lit(7).cast("long")}
    patch = {"title": F.when(k % 2 == 0, F.trim("o_orderpriority")), "status": F.when(k % 3 == 0, "done"), "updated": F.when(k % 5 == 0, k)}
    return fx.table(spark, d, "orders").select("o_orderkey", *[v.alias(n) for n, v in changes.update_from_previous(before, patch).items()])


@query("""SELECT o_orderkey, CASE WHEN seen THEN 'conflict' ELSE 'written' END AS answer, least(k, CAST(5 AS BIGINT)) AS size FROM (SELECT o_orderkey, count(*) OVER w AS k, count(*) OVER w > 5 AS seen FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def optimistic_mutate(spark, d):
    # a project takes five issues at most: every request sees the state that the ones before it left
    def attempt(state, row):
        full = state >= 5
        new = None if full else state + 1
        return new, (row[1], "conflict" if full else "written", state if full else state + 1)

    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return changes.mutate(o, ["o_orderdate", "o_orderkey"], lambda: 0, attempt, "o_orderkey long, answer string, size long")


# -- typed JSON --------------------------------------------------------------------------------------------------------

_CODEC = "k long, t string"
_JSON = f"""{MESSAGES}, j AS (SELECT stream_id, "offset", event_id, (event_id%97=0 OR event_id%89=0) AS bad FROM messages)"""


def _json_messages(spark, d):
    """JSON messages of the user streams, a few of which are broken or of another type."""
    i = F.col("event_id")
    sound = F.to_json(F.struct(i.alias("k"), F.col("event_type").alias("t")))
    text = F.when(i % 97 == 0, F.substring(sound, 1, 7)).when(i % 89 == 0, '{"k":"none","t":1}').otherwise(sound)
    return fx.messages(spark, d).select("stream_id", "offset", "event_id", text.cast("binary").alias("data"))


@query(f"""WITH {_JSON} SELECT stream_id, CASE WHEN bool_or(bad) THEN 'invalid-json' ELSE 'ok' END AS status, min("offset") FILTER (WHERE bad) AS "offset", CASE WHEN bool_or(bad) THEN NULL ELSE count(*) END AS n, CASE WHEN bool_or(bad) THEN NULL ELSE CAST(sum(event_id) AS BIGINT) END AS keys FROM j GROUP BY 1""")
def json_read_failfast(spark, d):
    got = jsonlayer.read(_json_messages(spark, d), jsonlayer.JsonCodec(_CODEC))
    return got.select("stream_id", "status", "offset", F.when(F.col("values").isNotNull(), F.size("values")).cast("long").alias("n"), F.aggregate(F.col("values.k"), F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@query(f"""WITH {_JSON} SELECT stream_id, "offset", event_id AS k FROM j WHERE stream_id NOT IN (SELECT stream_id FROM j WHERE bad)""")
def json_read_rows(spark, d):
    return jsonlayer.read_rows(_json_messages(spark, d), jsonlayer.JsonCodec(_CODEC)).select("stream_id", "offset", "value.k")


@query(f"""WITH {STREAMS} SELECT 'user/'||c_custkey AS stream_id, CASE WHEN s.stream_id IS NULL THEN 'not-found' WHEN soft_deleted THEN 'gone' WHEN user_id%4 IN (0,1) THEN 'ok' ELSE 'content-type-conflict' END AS status, content_type FROM customer LEFT JOIN streams s ON user_id=c_custkey""")
def json_get(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("user/"), "c_custkey").alias("stream_id"))
    return jsonlayer.get(fx.streams(spark, d), ids)


@query("""SELECT event_id, '{"k":'||event_id||',"t":"'||event_type||'"}' AS body, 'application/json' AS content_type FROM events""")
def json_append(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("t")).alias("value"))
    return jsonlayer.appends(e, jsonlayer.JsonCodec(_CODEC)).select("event_id", F.col("body").cast("string").alias("body"), "content_type")


# -- user folds and checkpoints ----------------------------------------------------------------------------------------


@query("""SELECT conv_id, CAST(sum(len(string_split(coalesce(text,''), ' '))) AS BIGINT) AS state FROM conversations GROUP BY 1""")
def materialize_words(spark, d):
    """A user's decode (a message gives an event per word) and fold (initial 0, evolve adds one)."""
    words = fold.events(fx.table(spark, d, "conversations"), F.split(F.coalesce("text", F.lit("")), " "), ["conv_id", "turn"])
    return fold.materialize(words, "conv_id", ["turn", "place"], F.lit(0).cast("long"), lambda state, event: state + 1, F.col("event"))


@query(f"""WITH {MESSAGES} SELECT stream_id AS view_id, "offset" AS applied_through, CAST(event_id AS VARCHAR) AS snapshot FROM messages QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY "offset" DESC)=1""")
def checkpoint_load(spark, d):
    m = fx.messages(spark, d)
    c = F.to_json(F.struct(F.create_map("stream_id", "offset").alias("cursors"), F.col("offset").alias("applied_through"), F.col("event_id").cast("string").alias("snapshot")))
    return load_checkpoints(m.select(F.col("stream_id").alias("view_id"), "offset", c.cast("binary").alias("data")), ["view_id"]).select("view_id", "applied_through", "snapshot")


# -- streaming ---------------------------------------------------------------------------------------------------------


def _thirds(spark, d):
    """Events as a stream of three files, one a micro-batch, in order of event_id."""
    e = fx.table(spark, d, "events")
    n = e.agg(F.max("event_id")).first()[0] + 1
    path = fx.shared_path(spark, "thirds")
    for i in range(3):
        e.where((F.col("event_id") >= n * i // 3) & (F.col("event_id") < n * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


_THIRDS = """n AS (SELECT max(event_id)+1 AS n FROM events), b(b) AS (VALUES (0),(1),(2)), e AS (SELECT 'k'||(event_id%300) AS key, event_id, value, event_type, CASE WHEN event_id<n//3 THEN 0 WHEN event_id<n*2//3 THEN 1 ELSE 2 END AS batch FROM events, n),
 s AS (SELECT b, key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS type FROM e JOIN b ON batch<=b GROUP BY ALL),
 v AS (SELECT b, key, value FROM s WHERE type<>'error' QUALIFY row_number() OVER (PARTITION BY b ORDER BY value DESC, key DESC)<=50)"""


@query(f"""WITH {_THIRDS} SELECT coalesce(x.key, y.key) AS key, CASE WHEN y.key IS NULL THEN 'enter' WHEN x.key IS NULL THEN 'exit' ELSE 'update' END AS delta, y.value AS old_value, x.value AS new_value, CAST(coalesce(x.b, y.b+1) AS BIGINT) AS batch
 FROM v x FULL JOIN (SELECT * FROM v WHERE b<2) y ON x.key=y.key AND x.b=y.b+1 WHERE x.value IS DISTINCT FROM y.value""")
def stream_topn_updates(spark, d):
    e = _thirds(spark, d).select(F.concat(F.lit("k"), F.col("event_id") % 300).alias("key"), "value", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"))
    return live.top_n_deltas(e, ["key"], "value", [F.desc("value"), F.desc("key")], 50, fx.shared_path(spark, "topn"), arrival="event_id").select("key", "delta", "old_value", "new_value", "batch")


@query("""SELECT 'user/'||user_id AS stream_id, CAST(sum(event_id) AS BIGINT) AS state, lpad(CAST(max(event_id) AS VARCHAR),16,'0') AS cursor FROM events GROUP BY 1""")
def stream_checkpointed_fold(spark, d):
    e = _thirds(spark, d).select(F.concat(F.lit("user/"), "user_id").alias("stream_id"), "event_id", F.lpad(F.col("event_id").cast("string"), 16, "0").alias("offset"))
    return live.checkpointed_fold(e, "stream_id", "event_id", "offset", fx.shared_path(spark, "fold"))


@query(f"""WITH {MESSAGES}, {STREAMS}, r AS (SELECT stream_id, current_offset, closed, soft_deleted, CASE WHEN user_id%3=0 THEN 'now-and-then' WHEN user_id%3=1 THEN {off_sql('user_id%40')} ELSE current_offset END AS "from", user_id FROM streams),
 k AS (SELECT r.*, CASE WHEN user_id%3=0 THEN {off_sql('0')} ELSE "from" END AS after FROM r),
 g AS (SELECT k.stream_id, "from", after, current_offset, closed, soft_deleted, count(m."offset") AS n, max(m."offset") AS last FROM k LEFT JOIN messages m ON m.stream_id=k.stream_id AND m."offset">after GROUP BY ALL),
 x AS (SELECT *, CASE WHEN closed THEN greatest(coalesce(last, current_offset), current_offset) ELSE coalesce(last, CASE WHEN after<current_offset THEN after END, current_offset) END AS nxt FROM g)
 SELECT stream_id, "from", CASE WHEN soft_deleted THEN 'gone' WHEN n>0 THEN 'ok' ELSE 'timeout' END AS status, CASE WHEN soft_deleted THEN 0 ELSE n END AS n_messages, CASE WHEN NOT soft_deleted THEN nxt END AS next_offset,
 CASE WHEN NOT soft_deleted THEN closed AND nxt=current_offset END AS closed FROM x""")
def live_read(spark, d):
    s, k = fx.streams(spark, d), F.col("user_id")
    at = F.concat(F.lpad((k % 40).cast("string"), 16, "0"), F.lit("_" + "0" * 16))
    readers = s.select("stream_id", F.when(k % 3 == 0, "now-and-then").when(k % 3 == 1, at).otherwise(F.col("current_offset")).alias("from"))
    return scan.live_step(fx.messages(spark, d), s, readers)


@query("""SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_windowed_counts(spark, d):
    e = _thirds(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    got = live.windowed_counts(e, "1 hour", "400 days", fx.shared_path(spark, "windows"))
    return got.select(F.unix_millis("start").alias("start_ms"), "event_type", F.col("count").alias("n"))


@query(f"""WITH {MESSAGES}, {STREAMS} SELECT 'message' AS what, count(*) AS n FROM messages JOIN streams USING (stream_id) WHERE NOT soft_deleted UNION ALL SELECT 'producer', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events) WHERE user_id%11<>0
 UNION ALL SELECT 'record', count(*) FROM streams WHERE NOT soft_deleted""")
def plain_purge(spark, d):
    """Soft-deleted streams are purged: messages, producers and records go together."""
    s, m = fx.streams(spark, d), fx.messages(spark, d)
    producers = m.select("stream_id", "event_type").distinct()
    left = lineage.purge({"message": m, "producer": producers, "record": s}, s.where("soft_deleted").select("stream_id"))
    count = lambda name: left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("message").unionByName(count("producer")).unionByName(count("record"))
