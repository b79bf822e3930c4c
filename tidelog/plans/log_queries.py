"""Queries that go through the log store: creates, appends, forks, deletion and expiry with their stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import create, expiry, lineage
from tidelog.plans import fixtures as fx
from tidelog.plans.fixtures import off_sql
from tidelog.plans.registry import query
from tidelog.sources.store import LogStore

_T0 = 946_684_800_000


def _null(t: str):
    return F.lit(None).cast(t)


def _creates(spark, d):
    """One stream per customer: JSON, text or untyped, some with initial data, some closed, some with a time to live."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "application/json").when(k % 3 == 1, "text/plain")
    body = F.when(k % 4 == 0, F.when(k % 3 == 0, "[1,2]").otherwise("[1,2]")).when(k % 4 == 1, F.when(k % 3 == 0, "{bad").otherwise("{bad"))
    return fx.table(spark, d, "customer").select(
        F.concat(F.lit("c/"), k).alias("stream_id"), F.lit(0).cast("long").alias("arrival"), kind.alias("content_type"), F.when(k % 5 == 0, k % 50 + 10).cast("long").alias("ttl_seconds"), _null("string").alias("expires_at"), (k % 10 == 3).alias("closed"),
        body.cast("binary").alias("body"), _null("string").alias("forked_from"), _null("string").alias("fork_offset"), _null("long").alias("fork_sub_offset"),
    )


_CREATES = """c AS (SELECT c_custkey AS k, 'c/'||c_custkey AS stream_id, CASE c_custkey%3 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type,
 c_custkey%3=0 AND c_custkey%4=1 AS bad, CASE WHEN c_custkey%4=0 THEN CASE WHEN c_custkey%3=0 THEN 2 ELSE 1 END WHEN c_custkey%4=1 THEN 1 ELSE 0 END AS n, c_custkey%10=3 AS closed, CASE WHEN c_custkey%5=0 THEN c_custkey%50+10 END AS ttl_seconds FROM customer)"""


@query(f"""WITH {_CREATES} SELECT stream_id, CASE WHEN bad THEN 'bad-request' ELSE 'created' END AS status, CASE WHEN NOT bad THEN {off_sql('n')} END AS next_offset, CASE WHEN NOT bad THEN content_type END AS content_type,
 CASE WHEN NOT bad THEN closed END AS closed, CASE WHEN NOT bad THEN {_T0}+ttl_seconds*1000 END AS expires_at_ms FROM c""")
def create_records(spark, d):
    decided, _ = create.plan(_creates(spark, d), spark.createDataFrame([], create.RECORD), _T0)
    return decided.select("stream_id", "status", "next_offset", "content_type", "closed", "expires_at_ms")


@query(f"""WITH {_CREATES}, p AS (SELECT *, unnest(range(1, n+1)) AS i FROM c WHERE NOT bad) SELECT stream_id, {off_sql('i')} AS "offset", CASE WHEN k%4=1 THEN '{{bad' WHEN k%3=0 THEN CAST(i AS VARCHAR) ELSE '[1,2]' END AS data FROM p""")
def create_messages(spark, d):
    _, m = create.plan(_creates(spark, d), spark.createDataFrame([], create.RECORD), _T0)
    return m.select("stream_id", "offset", F.col("data").cast("string").alias("data"))


@query(f"""WITH {_CREATES}, q AS (SELECT c.*, j FROM c, (VALUES (0),(1),(2)) t(j)) SELECT stream_id, CAST(j AS BIGINT) AS arrival, CASE WHEN bad THEN CASE WHEN j=0 THEN 'bad-request' WHEN j=1 THEN 'created' ELSE CASE WHEN closed THEN 'conflict' WHEN k%5=0 THEN 'conflict' ELSE 'exists' END END
 WHEN j=0 THEN 'created' WHEN j=1 THEN CASE WHEN closed OR k%5=0 THEN 'conflict' ELSE 'exists' END ELSE CASE WHEN closed OR k%5=0 THEN 'conflict' ELSE 'exists' END END AS status FROM q WHERE NOT (bad AND (closed OR k%5=0))""")
def create_again(spark, d):
    """The same stream asked for three times: the later requests name neither body, type, time to live nor closing."""
    first = _creates(spark, d)
    k = F.substring_index("stream_id", "/", -1).cast("long")
    plain = lambda n: first.withColumn("arrival", F.lit(n).cast("long")).withColumn("body", _null("binary")).withColumn("ttl_seconds", _null("long")).withColumn("closed", F.lit(False)).withColumn("content_type", F.when(k % 3 == 0, "application/json"))
    decided, _ = create.plan(first.unionByName(plain(1)).unionByName(plain(2)), spark.createDataFrame([], create.RECORD), _T0)
    return decided.where(~((k % 3 == 0) & (k % 4 == 1) & ((k % 10 == 3) | (k % 5 == 0)))).select("stream_id", "arrival", "status")


def _appends(spark, d):
    """One append per order to customers' streams (and to some that are not there): JSON arrays, [] closes, wrong types."""
    o, k = fx.table(spark, d, "orders"), F.col("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    kind = F.when(k % 3 == 0, "application/json").when(k % 3 == 1, "text/plain").otherwise("application/octet-stream")
    i = F.col("o_orderkey")
    return o.select(
        F.concat(F.when(i % 23 == 0, "gone/").otherwise("c/"), k).alias("stream_id"), F.row_number().over(w).cast("long").alias("arrival"), F.when(i % 19 == 0, "[]").otherwise(F.concat(F.lit("["), i, F.lit(",0]"))).cast("binary").alias("body"),
        F.when(i % 17 == 0, "image/png").otherwise(kind).alias("content_type"), _null("string").alias("seq"), F.when(i % 2 == 0, "p").alias("producer_id"), F.when(i % 2 == 0, 0).cast("long").alias("producer_epoch"), F.when(i % 2 == 0, 0).cast("long").alias("producer_seq"),
        F.lit(False).alias("close"), _null("string").alias("expected_offset"), i.alias("o_orderkey"),
    )


# a producer repeats sequence 0: its first accepted append stands, later ones are duplicates, whatever they carry
_APPENDS = f"""{_CREATES}, a AS (SELECT o_orderkey AS i, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS arrival FROM orders),
 j AS (SELECT a.*, CASE WHEN i%23=0 THEN 'gone/' ELSE 'c/' END||a.k AS stream_id, c.stream_id IS NOT NULL AND i%23<>0 AS there, c.content_type, coalesce(c.n,0) AS n0, c.closed,
 i%17<>0 AND NOT c.closed AS fine, CASE WHEN a.k%3<>0 THEN 1 WHEN i%19=0 THEN 0 ELSE 2 END AS n FROM a LEFT JOIN (SELECT * FROM c WHERE NOT bad) c ON c.k=a.k),
 f AS (SELECT *, CASE WHEN i%2=0 THEN min(CASE WHEN there AND fine AND i%2=0 THEN arrival END) OVER (PARTITION BY stream_id) END AS first FROM j),
 r AS (SELECT *, CASE WHEN NOT there THEN 'not-found' WHEN i%2=0 AND arrival>first THEN 'duplicate' WHEN closed THEN 'conflict:closed' WHEN i%17=0 THEN 'conflict:content-type' ELSE 'appended' END AS status FROM f),
 t AS (SELECT *, n0+sum(CASE WHEN status='appended' THEN n ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY arrival) AS tail FROM r)"""


def _log(spark, d) -> LogStore:
    log = LogStore(spark, fx.shared_path(spark, "log"))
    log.create(_creates(spark, d), _T0)
    return log


@query(f"WITH {_APPENDS} SELECT stream_id, arrival, status, CASE WHEN there THEN {off_sql('tail')} END AS next_offset FROM t")
def append_commit(spark, d):
    """Answers of a committed batch, with the tail that each request may wait for (a duplicate's is the present one)."""
    return _log(spark, d).append(_appends(spark, d).drop("o_orderkey"), _T0).select("stream_id", "arrival", "status", "next_offset")


@query(f"""WITH {_APPENDS}, m AS (SELECT stream_id, tail-n AS base, i, k, unnest(range(1, n+1)) AS p FROM t WHERE status='appended'), h AS (SELECT stream_id, k, n, unnest(range(1, n+1)) AS p FROM c WHERE NOT bad)
 SELECT stream_id, {off_sql('base+p')} AS "offset", CASE WHEN k%3<>0 THEN CASE WHEN i%19=0 THEN '[]' ELSE '['||i||',0]' END WHEN p=1 THEN CAST(i AS VARCHAR) ELSE '0' END AS data FROM m
 UNION ALL SELECT stream_id, {off_sql('p')}, CASE WHEN k%4=1 THEN '{{bad' WHEN k%3=0 THEN CAST(p AS VARCHAR) ELSE '[1,2]' END FROM h""")
def append_stored(spark, d):
    log = _log(spark, d)
    log.append(_appends(spark, d).drop("o_orderkey"), _T0)
    return log.snapshot().messages.select("stream_id", "offset", F.col("data").cast("string").alias("data"))


@query(f"""WITH {_APPENDS}, l AS (SELECT stream_id, max(tail) AS tail, bool_or(status='appended') AS hit FROM t GROUP BY 1) SELECT c.stream_id, {off_sql('coalesce(l.tail, c.n)')} AS current_offset, closed,
 {_T0}+CASE WHEN hit THEN 5000 ELSE 0 END+ttl_seconds*1000 AS expires_at_ms FROM c LEFT JOIN l USING (stream_id) WHERE NOT bad""")
def append_records(spark, d):
    """Records after the commit: tails moved on, and appends slid the times to live."""
    log = _log(spark, d)
    log.append(_appends(spark, d).drop("o_orderkey"), _T0 + 5_000)
    return log.snapshot().records.select("stream_id", "current_offset", "closed", "expires_at_ms")


@query("SELECT CAST(2 AS BIGINT) AS version, count(*) AS producers FROM (SELECT 1 FROM range(0))")
def log_version(spark, d):
    log = _log(spark, d)
    log.append(_appends(spark, d).drop("o_orderkey").where("false"), _T0)
    return spark.createDataFrame([(log.version(), log.snapshot().producers.count())], "version long, producers long")


def _forks(spark, d):
    """Two levels of forks of the customers' streams: places before and at the tail, too far, of other types, with sub-offsets."""
    k = F.col("c_custkey")
    place = F.when(k % 7 == 0, fx.default_offset(F.lit(9).cast("long"))).when(k % 7 == 1, "now").when(k % 7 == 2, F.lit(None).cast("string")).otherwise(fx.default_offset(F.lit(0).cast("long")))
    return fx.table(spark, d, "customer").select(
        F.concat(F.lit("f/"), k).alias("stream_id"), F.lit(0).cast("long").alias("arrival"), F.when(k % 11 == 0, "image/png").otherwise(_null("string")).alias("content_type"), F.when(k % 6 == 0, 9).cast("long").alias("ttl_seconds"), _null("string").alias("expires_at"),
        F.lit(True).alias("closed"), F.when(k % 4 == 2, F.lit("7")).cast("binary").alias("body"), F.concat(F.lit("c/"), k).alias("forked_from"), place.alias("fork_offset"), F.when(k % 7 >= 3, k % 4).cast("long").alias("fork_sub_offset"),
    )


_FORKS = f"""{_CREATES}, q AS (SELECT *, CASE k%7 WHEN 2 THEN n ELSE 0 END AS place, CASE WHEN k%7>=3 THEN k%4 ELSE 0 END AS sub, CASE WHEN k%4=2 THEN 1 ELSE 0 END AS body FROM c),
 r AS (SELECT *, CASE WHEN bad THEN 'not-found' WHEN k%7 IN (0,1) THEN 'bad-request' WHEN k%11=0 THEN 'conflict' WHEN sub>0 AND k%3=0 AND sub>n THEN 'bad-request' WHEN sub>0 AND k%3<>0 AND (n=0 OR sub>CASE WHEN k%4=1 THEN 4 ELSE 5 END) THEN 'bad-request' ELSE 'created' END AS status,
 CASE WHEN sub=0 THEN 0 WHEN k%3=0 THEN sub ELSE 1 END AS pre FROM q)"""


@query(f"""WITH {_FORKS} SELECT 'f/'||k AS stream_id, status, CASE WHEN status='created' THEN {off_sql('place')} END AS fork_offset, CASE WHEN status='created' THEN {off_sql('place+pre+body')} END AS next_offset, CASE WHEN status='created' THEN content_type END AS content_type,
 CASE WHEN status='created' THEN CASE WHEN k%6=0 THEN 9 ELSE ttl_seconds END END AS ttl_seconds, CASE WHEN status='created' THEN false END AS closed FROM r""")
def fork_records(spark, d):
    log = _log(spark, d)
    snap = log.snapshot()
    decided, _ = create.plan(_forks(spark, d), snap.records, _T0, messages=snap.messages)
    return decided.select("stream_id", "status", "fork_offset", "next_offset", "content_type", "ttl_seconds", "closed")


@query(f"""WITH {_FORKS}, x AS (SELECT *, unnest(range(1, pre+body+1)) AS p FROM r WHERE status='created') SELECT 'f/'||k AS stream_id, {off_sql('place+p')} AS "offset", CASE WHEN p>pre THEN '7' WHEN k%3=0 THEN CAST(p AS VARCHAR) ELSE substring(CASE WHEN k%4=1 THEN '{{bad' ELSE '[1,2]' END,1,sub) END AS data FROM x""")
def fork_prefixes(spark, d):
    log = _log(spark, d)
    snap = log.snapshot()
    _, m = create.plan(_forks(spark, d), snap.records, _T0, messages=snap.messages)
    return m.select("stream_id", "offset", F.col("data").cast("string").alias("data"))


@query(f"""WITH {_FORKS} SELECT 'f/'||k AS stream_id, CASE WHEN status='created' THEN 'ok' ELSE 'not-found' END AS status, CASE WHEN status='created' THEN place+pre+body ELSE 0 END AS n_messages, CASE WHEN status='created' THEN {off_sql('place+pre+body')} END AS next_offset FROM r""")
def fork_read(spark, d):
    log = _log(spark, d)
    log.create(_forks(spark, d), _T0)
    answers, _ = log.read(_forks(spark, d).select("stream_id", _null("string").alias("from")), _T0)
    return answers.select("stream_id", "status", "n_messages", "next_offset")


@query(f"""WITH {_FORKS}, g AS (SELECT k, stream_id AS id, bad, status FROM r) SELECT 'c/'||k AS stream_id, CASE WHEN bad THEN 'not-found' WHEN status='created' THEN 'retained-soft-deleted' ELSE 'purged' END AS status FROM g""")
def delete_commit(spark, d):
    """Delete every customer's stream: those with forks stay, soft-deleted; the others go with messages and producers."""
    log = _log(spark, d)
    log.create(_forks(spark, d), _T0)
    return log.delete(_creates(spark, d).select("stream_id"), _T0)


@query(f"""WITH {_FORKS} SELECT 'f/'||k AS stream_id, 'record' AS what, CAST(1 AS BIGINT) AS n FROM r WHERE status='created' AND k%6<>0 AND (k%5<>0) UNION ALL SELECT 'c/'||k, 'record', 1 FROM r WHERE status='created' AND k%6<>0 AND k%5<>0
 UNION ALL SELECT 'c/'||k, 'messages', n FROM r WHERE status='created' AND k%6<>0 AND k%5<>0 AND n>0 UNION ALL SELECT 'f/'||k, 'messages', pre+body FROM r WHERE status='created' AND k%6<>0 AND k%5<>0 AND pre+body>0""")
def purge_all_three(spark, d):
    """After all customers' streams are deleted and all times to live are over: what is left of records and messages."""
    log = _log(spark, d)
    log.create(_forks(spark, d), _T0)
    log.delete(_creates(spark, d).select("stream_id"), _T0)
    log.expire(_T0 + 10**9)
    snap = log.snapshot()
    left = snap.records.groupBy("stream_id").agg(F.count("*").alias("n")).select("stream_id", F.lit("record").alias("what"), "n")
    return left.unionByName(snap.messages.groupBy("stream_id").agg(F.count("*").alias("n")).select("stream_id", F.lit("messages").alias("what"), "n"))


_DEADLINES = "s AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS stream_id, CASE WHEN c_custkey%4<>0 THEN (c_custkey%90)*1000 END AS expires_at_ms, CASE WHEN c_custkey>=2 THEN c_custkey//2 END AS p, c_custkey%7=0 AS soft_deleted FROM customer)"


def _deadlines(spark, d):
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        k.cast("string").alias("stream_id"), F.when(k % 4 != 0, (k % 90) * 1000).alias("expires_at_ms"), F.when(k >= 2, F.floor(k / 2).cast("string")).alias("forked_from"), F.when(k >= 2, F.lit("0" * 16 + "_" + "0" * 16)).alias("fork_offset"),
        (k % 7 == 0).alias("soft_deleted"), F.when(k % 3 == 0, 30).cast("long").alias("ttl_seconds"),
    )


@query(f"""WITH {_DEADLINES}, n AS (SELECT p, count(*) AS n FROM s GROUP BY 1) SELECT stream_id, CASE WHEN soft_deleted THEN 'gone' WHEN expires_at_ms<=45000 THEN CASE WHEN n.n>0 THEN 'gone' ELSE 'not-found' END ELSE 'visible' END AS status FROM s LEFT JOIN n ON n.p=s.k""")
def lazy_expiry(spark, d):
    s = _deadlines(spark, d)
    return expiry.access(s, lineage.dependents(s), 45_000)


@query(f"""WITH {_DEADLINES}, t AS (SELECT stream_id, CAST(45000 AS BIGINT) AS at_ms FROM s UNION ALL SELECT 'none', 45000) SELECT t.stream_id, at_ms, CASE WHEN s.k IS NULL OR expires_at_ms IS NULL THEN 'drop' WHEN expires_at_ms<=at_ms THEN 'delete' ELSE 're-arm' END AS action,
 CASE WHEN expires_at_ms>at_ms THEN expires_at_ms END AS next_ms FROM t LEFT JOIN s USING (stream_id)""")
def scheduled_expiry(spark, d):
    s = _deadlines(spark, d)
    timers = s.select("stream_id").unionByName(spark.createDataFrame([("none",)], "stream_id string")).withColumn("at_ms", F.lit(45_000).cast("long"))
    return expiry.fire(timers, s)


@query(f"""WITH {_DEADLINES} SELECT stream_id, CASE WHEN k%3=0 AND k%2=0 THEN 50000+k+30000 ELSE expires_at_ms END AS expires_at_ms FROM s""")
def read_touch(spark, d):
    s = _deadlines(spark, d)
    k = F.col("stream_id").cast("long")
    reads = s.select("stream_id", (k + 50_000).alias("at_ms"), F.when(k % 2 == 0, "read").otherwise("live-read").alias("reason"))
    return expiry.touch(s, reads).select("stream_id", "expires_at_ms")


@query(f"""WITH {_DEADLINES}, n AS (SELECT p, count(*) AS n FROM s GROUP BY 1), x AS (SELECT stream_id, soft_deleted, coalesce(n.n,0) AS n FROM s LEFT JOIN n ON n.p=s.k) SELECT stream_id, policy, CASE WHEN soft_deleted THEN 'gone'
 WHEN CASE policy WHEN 'copy-on-fork' THEN 0 WHEN 'ttl-only' THEN 1 ELSE n END>0 THEN 'retained-soft-deleted' ELSE 'purged' END AS status FROM x, (VALUES ('ref-count'),('reverse-index'),('copy-on-fork'),('ttl-only')) t(policy)""")
def delete_policies(spark, d):
    s, got = _deadlines(spark, d), None
    for policy in lineage.POLICIES:
        one = lineage.delete_status(s, policy).select("stream_id", F.lit(policy).alias("policy"), "status")
        got = one if got is None else got.unionByName(one)
    return got
