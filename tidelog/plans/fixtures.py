"""Deterministic logs derived from the star-schema tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.offsets import default_offset
from tidelog.sources.shared import shared_path  # noqa: F401

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ms(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """One stream per user; arrival by (ts, event_id)."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    arrival = F.row_number().over(w).cast("long")
    return e.select(
        F.concat(F.lit("user/"), F.col("user_id")).alias("stream_id"), "user_id", "event_id", "event_type", "value", "props", _ms("ts").alias("timestamp"), arrival.alias("arrival"),
        F.concat(F.lit('{"type":"'), "event_type", F.lit('","p":'), "props", F.lit("}")).alias("data"),
    ).withColumn("offset", default_offset(F.col("arrival")))


MESSAGES = """msg AS (SELECT 'user/'||user_id AS stream_id, user_id, event_id, event_type, value, props, epoch_us(ts)//1000 AS "timestamp",
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival, '{"type":"'||event_type||'","p":'||props||'}' AS data FROM events),
messages AS (SELECT *, lpad(CAST(arrival AS VARCHAR),16,'0')||'_0000000000000000' AS "offset" FROM msg)"""


def streams(spark: SparkSession, d: str) -> DataFrame:
    """Records of the user streams; some tails lie before the last rows (crash leftovers)."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    k = F.col("user_id")
    kinds = F.array(*map(F.lit, ("application/json", "Application/JSON; charset=utf-8", "text/plain", "application/json-seq")))
    return u.select(
        F.concat(F.lit("user/"), k).alias("stream_id"), "user_id", F.get(kinds, (k % 4).cast("int")).alias("content_type"),
        default_offset(F.greatest(F.col("n") - k % 3, F.lit(0))).alias("current_offset"),
        (k % 5 == 0).alias("closed"), (k % 11 == 0).alias("soft_deleted"), F.when(k % 7 != 0, (k % 7) * 3600).alias("ttl_seconds"), F.lit(None).cast("string").alias("expires_at"),
    )


STREAMS = """streams AS (SELECT 'user/'||user_id AS stream_id, user_id,
 CASE user_id%4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'Application/JSON; charset=utf-8' WHEN 2 THEN 'text/plain' ELSE 'application/json-seq' END AS content_type,
 lpad(CAST(greatest(count(*)-user_id%3,0) AS VARCHAR),16,'0')||'_0000000000000000' AS current_offset, user_id%5=0 AS closed, user_id%11=0 AS soft_deleted,
 CASE WHEN user_id%7<>0 THEN (user_id%7)*3600 END AS ttl_seconds, CAST(NULL AS VARCHAR) AS expires_at FROM events GROUP BY user_id)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    """Change log over 40 keys per 10 users; every 701st event is a reset, every 97th starts and every 101st ends a snapshot of its scope."""
    m = messages(spark, d).drop("offset", "arrival")
    scope = F.concat(F.lit("c"), F.col("user_id") % 10)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    w = Window.partitionBy("scope").orderBy("timestamp", "event_id")
    control = F.when(F.col("event_id") % 701 == 0, "reset").when(F.col("event_id") % 97 == 0, "snapshot-start").when(F.col("event_id") % 101 == 0, "snapshot-end")
    return m.withColumn("scope", scope).select(
        "scope", default_offset(F.row_number().over(w).cast("long")).alias("offset"), F.concat(F.lit("k"), F.col("event_id") % 40).alias("key"), op.alias("operation"), control.alias("control"),
        F.when(op != "delete", F.col("data")).alias("value"), "event_id",
    )


CHANGES = (
    MESSAGES
    + """,
changes AS (SELECT 'c'||(user_id%10) AS scope, lpad(CAST(row_number() OVER (PARTITION BY user_id%10 ORDER BY "timestamp", event_id) AS VARCHAR),16,'0')||'_0000000000000000' AS "offset",
 'k'||(event_id%40) AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation,
 CASE WHEN event_id%701=0 THEN 'reset' WHEN event_id%97=0 THEN 'snapshot-start' WHEN event_id%101=0 THEN 'snapshot-end' END AS control,
 CASE WHEN event_type<>'error' THEN data END AS value, event_id FROM messages)"""
)


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Appends with duplicates, gaps, stale epochs, sequences, closes, wrong types and stale expectations."""
    m = messages(spark, d)
    i, a = F.col("event_id"), F.col("arrival")
    seq = F.pmod(a - 1, F.lit(20))
    seq = F.when(i % 37 == 0, seq + 2).when(i % 11 == 0, F.greatest(seq - 1, F.lit(0))).otherwise(seq)
    epoch = F.floor((a - 1) / 20) - F.when(i % 53 == 0, 1).otherwise(0)
    close_only = (F.col("event_type") == "purchase") & (i % 97 == 0)
    return m.select(
        "stream_id", "arrival", "event_id", F.when(close_only, 0).otherwise(1).cast("long").alias("n_messages"), (i % 29 != 0).alias("type_ok"),
        F.when(i % 5 == 0, F.lpad(((i * 7919) % 1000).cast("string"), 4, "0")).alias("seq"), F.when(i % 2 == 0, F.lit("p")).alias("producer_id"),
        epoch.cast("long").alias("producer_epoch"), seq.cast("long").alias("producer_seq"), close_only.alias("close"), F.when(i % 13 == 0, default_offset(F.greatest(a - 1 - i % 3, F.lit(0)))).alias("expected_offset"),
    )


ATTEMPTS = (
    MESSAGES
    + """,
attempts AS (SELECT stream_id, arrival, event_id, CAST(CASE WHEN event_type='purchase' AND event_id%97=0 THEN 0 ELSE 1 END AS BIGINT) AS n_messages, event_id%29<>0 AS type_ok,
 CASE WHEN event_id%5=0 THEN lpad(CAST((event_id*7919)%1000 AS VARCHAR),4,'0') END AS seq, CASE WHEN event_id%2=0 THEN 'p' END AS producer_id,
 (arrival-1)//20 - CASE WHEN event_id%53=0 THEN 1 ELSE 0 END AS pe,
 CASE WHEN event_id%37=0 THEN (arrival-1)%20+2 WHEN event_id%11=0 THEN greatest((arrival-1)%20-1,0) ELSE (arrival-1)%20 END AS ps,
 (event_type='purchase' AND event_id%97=0) AS closing, CASE WHEN event_id%13=0 THEN lpad(CAST(greatest(arrival-1-event_id%3,0) AS VARCHAR),16,'0')||'_0000000000000000' END AS expected FROM messages)"""
)


def forest(spark: SparkSession, d: str) -> DataFrame:
    """A forest of forks over customers: c forks c // 2; fork offsets sometimes lie before the parent's own fork offset.

    tail(c) = fork offset + own orders; fo(c) = floor(tail(parent) * (c % 5) / 4), computed level by level.
    """
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c")).join(n, "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))
    c = c.withColumn("p", F.when(F.col("c") >= 2, F.floor(F.col("c") / 2)))
    # the path to the root has at most 64 steps: fold it inside the row, over the ancestors' order counts
    path = F.expr("filter(transform(sequence(0, 63), i -> shiftright(c, i)), (x, i) -> x >= 1 or (i = 0 and x = 0))")
    steps = c.select("c", "n", "p", F.posexplode(path).alias("k", "x")).join(c.select(F.col("c").alias("x"), F.col("n").alias("nx")), "x")
    fold = steps.groupBy("c", "n", "p").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "x", "nx"))).alias("chain"))
    return fold.select(
        F.col("c").alias("id"), F.col("c").cast("string").alias("stream_id"), F.col("p").cast("string").alias("forked_from"), "n",
        F.expr("""aggregate(chain, struct(0L as fo, 0L as tail), (a, s) -> named_struct('fo', if(s.x >= 2, cast(floor(a.tail * (s.x % 5) / 4) as bigint), 0L),
          'tail', if(s.x >= 2, cast(floor(a.tail * (s.x % 5) / 4) as bigint), 0L) + s.nx))""").alias("r"),
    ).select("id", "stream_id", "forked_from", "n", F.when(F.col("forked_from").isNotNull(), F.col("r.fo")).alias("fo"), F.col("r.tail").alias("tail"), default_offset(F.when(F.col("forked_from").isNotNull(), F.col("r.fo"))).alias("fork_offset"), default_offset(F.col("r.tail")).alias("current_offset"))


def forest_messages(spark: SparkSession, d: str, f: DataFrame) -> DataFrame:
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = o.select(F.col("o_custkey").alias("id"), "o_orderkey", F.row_number().over(w).cast("long").alias("k"))
    return m.join(f.select("id", "stream_id", "fo"), "id").select("stream_id", "o_orderkey", default_offset(F.coalesce("fo", F.lit(0)) + F.col("k")).alias("offset"))


FOREST = """RECURSIVE n AS (SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey=c_custkey) AS n FROM customer),
f AS (SELECT c AS id, CAST(NULL AS BIGINT) AS p, n, CAST(NULL AS BIGINT) AS fo, n AS tail FROM n WHERE c<2
 UNION ALL SELECT n.c, f.id, n.n, f.tail*(n.c%5)//4, f.tail*(n.c%5)//4+n.n FROM n JOIN f ON n.c//2=f.id WHERE n.c>=2),
own AS (SELECT o_custkey AS id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
m AS (SELECT own.id, o_orderkey, coalesce(fo,0)+k AS place FROM own JOIN f ON own.id=f.id),
anc AS (SELECT id AS leaf, id AS a, CAST(NULL AS BIGINT) AS hi, 0 AS depth FROM f
 UNION ALL SELECT anc.leaf, f.p, least(coalesce(anc.hi,f.fo), f.fo), anc.depth+1 FROM anc JOIN f ON anc.a=f.id WHERE f.p IS NOT NULL)"""


def off_sql(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR),16,'0')||'_0000000000000000'"
