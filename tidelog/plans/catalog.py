"""Every log query with its SQL. Each takes (spark, directory of the tables) and works on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import media, offsets, scalars
from tidelog.operators import admit, changes, expiry, fold, lineage, scan, views
from tidelog.plans import fixtures as fx
from tidelog.plans.fixtures import ATTEMPTS, CHANGES, FOREST, MESSAGES, STREAMS, off_sql
from tidelog.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from tidelog.sources import jsonl
from tidelog.sources.shared import cut
from tidelog.streaming import live

# -- scans and offsets ---------------------------------------------------------------------------------------------


@query(f'WITH {MESSAGES} SELECT stream_id, event_id, "offset" FROM messages')
def offset_allocate(spark, d):
    m = fx.table(spark, d, "events").select(F.concat(F.lit("user/"), F.col("user_id")).alias("stream_id"), "ts", "event_id")
    return admit.allocate_offsets(m, ["ts", "event_id"]).select("stream_id", "event_id", "offset")


@query(f"""WITH {MESSAGES} SELECT "offset", data FROM messages WHERE stream_id='user/7' AND "offset">{off_sql("3")} AND "offset"<={off_sql("40")} ORDER BY "offset" LIMIT 25""")
def offset_window_scan(spark, d):
    at = lambda n: f"{n:016d}_{0:016d}"
    return scan.range_scan(fx.messages(spark, d).where("user_id = 7"), "user/7", at(3), at(40), 25).select("offset", "data")


@query(f"""WITH {MESSAGES} SELECT m.stream_id, count(*) AS n, min("offset") AS first, max("offset") AS last FROM messages m
 WHERE "offset">{off_sql("user_id%9")} AND "offset"<={off_sql("user_id%50+20")} GROUP BY m.stream_id""")
def offset_windows_all(spark, d):
    k = F.col("user_id")
    bounds = fx.streams(spark, d).select("stream_id", offsets.default_offset(k % 9).alias("after"), offsets.default_offset(k % 50 + 20).alias("until"))
    return scan.windowed(fx.messages(spark, d), bounds).groupBy("stream_id").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"))


@query("""WITH c AS (SELECT event_id, CASE event_id%8 WHEN 0 THEN lpad(CAST(event_id AS VARCHAR),16,'0')||'_0000000000000000' WHEN 1 THEN '-1' WHEN 2 THEN 'now' WHEN 3 THEN 'a,b'
 WHEN 4 THEN '' WHEN 5 THEN repeat('x',event_id%300) WHEN 6 THEN 'k=v' ELSE props END AS o FROM events)
 SELECT event_id, length(o) BETWEEN 1 AND 255 AND o NOT IN ('-1','now') AND NOT regexp_matches(o,'[,&=?/]') AS valid, regexp_matches(o,'^[0-9]{16}_[0-9]{16}$') AS default_shape,
 CASE WHEN o IN ('','-1') THEN NULL ELSE o END AS read_from FROM c""")
def offset_validate(spark, d):
    i = F.col("event_id")
    made = [offsets.default_offset(i), F.lit("-1"), F.lit("now"), F.lit("a,b"), F.lit(""), F.expr("repeat('x', cast(event_id % 300 as int))"), F.lit("k=v"), F.col("props")]
    o = F.get(F.array(*made), (i % 8).cast("int"))
    e = fx.table(spark, d, "events").select("event_id", o.alias("o"))
    return e.select("event_id", offsets.is_valid(F.col("o")).alias("valid"), offsets.has_default_shape(F.col("o")).alias("default_shape"), offsets.read_start(F.col("o")).alias("read_from"))


_CATCH_UP = f"""WITH {MESSAGES}, {STREAMS}, r AS (SELECT s.*, CASE user_id%3 WHEN 0 THEN '-1' WHEN 1 THEN {off_sql("user_id%30")} ELSE current_offset END AS start FROM streams s),
 j AS (SELECT r.stream_id, r.start, r.current_offset, r.closed, r.soft_deleted, count(m."offset") AS n, max(m."offset") AS last FROM r LEFT JOIN messages m ON m.stream_id=r.stream_id AND m."offset"<=r.current_offset
 AND (r.start='-1' OR m."offset">r.start) GROUP BY ALL), k AS (SELECT *, coalesce(last, nullif(start,'-1'), current_offset) AS nxt FROM j)
 SELECT stream_id, start AS "from", CASE WHEN soft_deleted THEN 'gone' ELSE 'visible' END AS status, CASE WHEN soft_deleted THEN 0 ELSE n END AS n_messages, CASE WHEN NOT soft_deleted THEN nxt END AS next_offset,
 CASE WHEN NOT soft_deleted THEN nxt>=current_offset END AS up_to_date, CASE WHEN NOT soft_deleted THEN closed AND nxt>=current_offset END AS closed FROM k"""


@query(_CATCH_UP)
def catch_up_read(spark, d):
    s = fx.streams(spark, d)
    k = F.col("user_id")
    ask = s.select("stream_id", F.when(k % 3 == 0, "-1").when(k % 3 == 1, offsets.default_offset(k % 30)).otherwise(F.col("current_offset")).alias("from"))
    return scan.catch_up(fx.messages(spark, d), s, ask)


@query(f"WITH {STREAMS} SELECT stream_id, current_offset AS next_offset FROM streams")
def tail_now(spark, d):
    return scan.tail(fx.streams(spark, d))


@query(f"""WITH {MESSAGES}, {STREAMS} SELECT m.stream_id, count(*) AS n FROM messages m JOIN streams s USING(stream_id) WHERE m."offset"<=s.current_offset GROUP BY 1""")
def tail_visible(spark, d):
    return scan.visible_tail(fx.messages(spark, d), fx.streams(spark, d)).groupBy("stream_id").agg(F.count("*").alias("n"))


@query(f"""WITH {STREAMS} SELECT stream_id, CASE WHEN soft_deleted THEN 'gone' ELSE 'visible' END AS status, content_type, current_offset AS next_offset, ttl_seconds, expires_at, closed FROM streams""")
def record_metadata(spark, d):
    return scan.metadata(fx.streams(spark, d))


@query(f"""WITH {STREAMS}, ids AS (SELECT 'user/'||c_custkey AS stream_id FROM customer) SELECT i.stream_id, CASE WHEN s.stream_id IS NULL THEN 'not-found' WHEN s.soft_deleted THEN 'gone' ELSE 'visible' END AS status
 FROM ids i LEFT JOIN streams s USING(stream_id)""")
def visibility_status(spark, d):
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("user/"), F.col("c_custkey")).alias("stream_id"))
    s = fx.streams(spark, d).select("stream_id", "soft_deleted", F.lit(True).alias("there"))
    return ids.join(s, "stream_id", "left").select("stream_id", scan.visibility(F.col("there").isNotNull(), F.col("soft_deleted")).alias("status"))


@query(f"""WITH {STREAMS} SELECT stream_id, (soft_deleted AND user_id%2=0) OR (closed AND user_id%3<>0) OR current_offset<>{off_sql("60")} AS changed FROM streams""")
def change_snapshot_diff(spark, d):
    k = F.col("user_id")
    seen = offsets.default_offset(F.lit(60))
    return fx.streams(spark, d).select("stream_id", scan.snapshot_differs(F.lit(True), F.col("soft_deleted"), F.col("closed"), F.col("current_offset"), k % 2 != 0, k % 3 == 0, seen).alias("changed"))


@query(f"""WITH {MESSAGES}, {STREAMS} SELECT m.stream_id, m."offset", closed, soft_deleted FROM messages m JOIN streams s USING(stream_id) WHERE m.stream_id='user/42' AND m."offset"<>'0000000000000000_0000000000000000'""")
def commit_fanin(spark, d):
    m = fx.messages(spark, d).where("stream_id = 'user/42'").where(F.col("offset") != offsets.ZERO)
    return m.join(fx.streams(spark, d).select("stream_id", "closed", "soft_deleted"), "stream_id").select("stream_id", "offset", "closed", "soft_deleted")


# -- media types, framing, bodies ----------------------------------------------------------------------------------


@query(f"""WITH {STREAMS} SELECT stream_id, trim(split_part(lower(content_type),';',1)) AS media_type, trim(split_part(lower(content_type),';',1))='application/json' AS matches_json FROM streams""")
def content_type_match(spark, d):
    c = F.col("content_type")
    return fx.streams(spark, d).select("stream_id", media.media_type(c).alias("media_type"), media.media_matches(c, F.lit("application/json; x=1")).alias("matches_json"))


@query(f"""WITH {STREAMS} SELECT lower(content_type) LIKE 'application/json%' AS by_prefix, trim(split_part(lower(content_type),';',1))='application/json' AS exact, count(*) AS n FROM streams GROUP BY ALL""")
def json_media_prefix_vs_exact(spark, d):
    c = F.col("content_type")
    return fx.streams(spark, d).groupBy(media.json_by_prefix(c).alias("by_prefix"), media.json_exact(c).alias("exact")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT conv_id, '['||string_agg(CAST(turn AS VARCHAR),',' ORDER BY turn)||']' AS body FROM conversations GROUP BY 1), i AS (SELECT conv_id, unnest(CAST(CAST(body AS JSON) AS BIGINT[])) AS item FROM b)
 SELECT conv_id, CAST(item AS VARCHAR) AS item, count(*) AS n FROM i GROUP BY ALL""")
def json_array_flatten(spark, d):
    c = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    c = c.select("conv_id", F.to_json("t").alias("body"))
    return c.select("conv_id", F.explode(media.framed(F.col("body"), F.lit(True))).alias("item")).groupBy("conv_id", "item").agg(F.count("*").alias("n"))


@query(f"""WITH {MESSAGES} SELECT stream_id, '['||string_agg(data,',' ORDER BY arrival)||']' AS body FROM messages GROUP BY 1""")
def json_body_concat(spark, d):
    m = fx.messages(spark, d).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("offset", "data"))).alias("m"))
    return m.select("stream_id", media.json_body(F.col("m.data")).alias("body"))


@query("""SELECT conv_id, string_agg(coalesce(text,''),'' ORDER BY turn, role, text) AS body FROM conversations GROUP BY 1""")
def message_batches_text(spark, d):
    c = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"))
    return c.select("conv_id", F.array_join(F.col("m.text"), "").alias("body"))


@query("SELECT conv_id, CAST(sum(octet_length(encode(coalesce(text,'')))) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def batch_bytes_len(spark, d):
    c = fx.table(spark, d, "conversations").withColumn("b", F.coalesce("text", F.lit("")).cast("binary")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "b"))).alias("m"))
    return c.select("conv_id", F.octet_length(media.bytes_body(F.col("m.b"))).cast("long").alias("bytes"))


@query("""SELECT event_id, CASE event_id%4 WHEN 0 THEN CASE WHEN 1=1 THEN 2 END WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE NULL END AS n FROM events""")
def frame_counts(spark, d):
    i = F.col("event_id") % 4
    body = F.when(i == 0, F.concat(F.lit("["), "props", F.lit(', "a"]'))).when(i == 1, "[]").when(i == 2, F.col("props")).otherwise("{bad")
    return fx.table(spark, d, "events").select("event_id", F.size(media.framed(body, F.lit(True))).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("""SELECT page_id, length(regexp_replace(coalesce(url,''),'\\r\\n|\\r|\\n','|','g')) AS n, '"'||to_base64(encode(coalesce(url,'')))||':'||'-1'||':'||CAST(page_id AS VARCHAR)||CASE WHEN page_id%2=0 THEN ':c' ELSE '' END||'"' AS etag FROM pages""")
def etag_lines(spark, d):
    u = F.coalesce("url", F.lit(""))
    return fx.table(spark, d, "pages").select("page_id", F.length(F.array_join(media.event_lines(u), "|")).alias("n"), media.etag(u, F.lit("-1"), F.col("page_id").cast("string"), F.col("page_id") % 2 == 0).alias("etag"))


# -- admission -----------------------------------------------------------------------------------------------------

_PRODUCER = f"""WITH RECURSIVE {ATTEMPTS}, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival) AS k FROM attempts WHERE producer_id IS NOT NULL),
 r AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS arrival, '' AS status FROM (SELECT DISTINCT stream_id FROM a)
 UNION ALL SELECT stream_id, k, CASE WHEN st='accepted' THEN pe ELSE e END, CASE WHEN st='accepted' THEN ps ELSE s END, arrival, st FROM (
 SELECT a.stream_id, a.k, r.e, r.s, a.pe, a.ps, a.arrival, CASE WHEN r.e IS NULL THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'producer-gap' END WHEN pe<r.e THEN 'stale-epoch'
 WHEN pe>r.e THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'invalid-epoch-seq' END WHEN ps<=r.s THEN 'duplicate' WHEN ps=r.s+1 THEN 'accepted' ELSE 'producer-gap' END AS st
 FROM r JOIN a ON a.stream_id=r.stream_id AND a.k=r.k+1) x)"""


@query(_PRODUCER + " SELECT stream_id, arrival, status FROM r WHERE k>0")
def producer_admission(spark, d):
    a = fx.attempts(spark, d).where("producer_id is not null")
    return admit.admit_producers(a, ["arrival"]).select("stream_id", "arrival", "status")


@query(_PRODUCER + " SELECT stream_id, e AS epoch, s AS last_seq FROM r QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY k DESC)=1")
def producer_final_state(spark, d):
    got = admit.admit_producers(fx.attempts(spark, d).where("producer_id is not null"), ["arrival"])
    return got.groupBy("stream_id").agg(F.max_by(F.struct("epoch", "last_seq"), "arrival").alias("s")).select("stream_id", "s.epoch", "s.last_seq")


@query(f"""WITH {ATTEMPTS} SELECT stream_id, arrival, seq IS NULL OR coalesce(seq > max(seq) OVER (PARTITION BY stream_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM attempts""")
def seq_guard(spark, d):
    return admit.seq_guard(fx.attempts(spark, d), ["arrival"]).select("stream_id", "arrival", "accepted")


@query(f"""WITH {ATTEMPTS} SELECT stream_id, count(*) FILTER (WHERE c IS NULL OR arrival<=c) AS before_close, count(*) FILTER (WHERE arrival>c) AS rejected
 FROM (SELECT *, min(CASE WHEN closing THEN arrival END) OVER (PARTITION BY stream_id) AS c FROM attempts) GROUP BY 1""")
def close_guard(spark, d):
    a = fx.attempts(spark, d)
    a = a.withColumn("c", F.min(F.when(F.col("close"), F.col("arrival"))).over(Window.partitionBy("stream_id")))
    late = F.coalesce(F.col("arrival") > F.col("c"), F.lit(False))
    return a.groupBy("stream_id").agg(F.sum((~late).cast("long")).alias("before_close"), F.sum(late.cast("long")).alias("rejected"))


_APPEND = f"""WITH RECURSIVE {ATTEMPTS},
 r AS (SELECT stream_id, CAST(0 AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS n, false AS closed, CAST(NULL AS VARCHAR) AS q, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS s, '' AS status FROM (SELECT DISTINCT stream_id FROM attempts)
 UNION ALL SELECT stream_id, arrival, CASE WHEN chg THEN n+n_messages ELSE n END, CASE WHEN chg THEN closed OR closing ELSE closed END, CASE WHEN chg THEN coalesce(seq,q) ELSE q END,
 CASE WHEN chg AND pid IS NOT NULL THEN pe ELSE e END, CASE WHEN chg AND pid IS NOT NULL THEN ps ELSE s END, st FROM (
 SELECT *, st='appended' AND NOT (closing AND n_messages=0 AND closed) AS chg FROM (
 SELECT *, CASE WHEN pst<>'accepted' THEN pst WHEN closing AND n_messages=0 THEN CASE WHEN closed OR NOT stale THEN 'appended' ELSE 'conflict:expected-offset' END
 WHEN closed THEN 'conflict:closed' WHEN NOT type_ok THEN 'conflict:content-type' WHEN seq IS NOT NULL AND q IS NOT NULL AND seq<=q THEN 'conflict:sequence' WHEN stale THEN 'conflict:expected-offset' ELSE 'appended' END AS st FROM (
 SELECT a.stream_id, a.arrival, a.n_messages, a.type_ok, a.seq, a.pe, a.ps, a.closing, a.producer_id AS pid, r.n, r.closed, r.q, r.e, r.s,
 coalesce(a.expected<>{off_sql("r.n")}, false) AS stale, CASE WHEN a.producer_id IS NULL THEN 'accepted' WHEN r.e IS NULL THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'producer-gap' END WHEN pe<r.e THEN 'stale-epoch'
 WHEN pe>r.e THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'invalid-epoch-seq' END WHEN ps<=r.s THEN 'duplicate' WHEN ps=r.s+1 THEN 'accepted' ELSE 'producer-gap' END AS pst
 FROM r JOIN attempts a ON a.stream_id=r.stream_id AND a.arrival=r.arrival+1) x) y) z)"""


@query(_APPEND + f" SELECT stream_id, arrival, status, {off_sql('n')} AS tail, closed FROM r WHERE arrival>0")
def append_decisions(spark, d):
    return admit.admit_appends(fx.attempts(spark, d), ["arrival"]).select("stream_id", "arrival", "status", "tail", "closed")


@query(_APPEND + """, c(status, code) AS (VALUES ('appended',204),('duplicate',204),('not-found',404),('gone',410),('conflict:closed',409),('conflict:expected-offset',409),('conflict:content-type',409),
 ('conflict:sequence',409),('busy',503),('stale-epoch',403),('producer-gap',409),('invalid-epoch-seq',400)) SELECT status, code, count(*) AS n FROM r JOIN c USING(status) WHERE arrival>0 GROUP BY ALL""")
def append_status_mix(spark, d):
    got = admit.admit_appends(fx.attempts(spark, d), ["arrival"])
    return got.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(admit.status_codes(spark)), "status").select("status", "code", "n")


@query(_APPEND + f", l AS (SELECT stream_id, arrival, lag(n) OVER (PARTITION BY stream_id ORDER BY arrival) AS before FROM r) SELECT a.stream_id, a.arrival, a.expected={off_sql('l.before')} AS matches FROM l JOIN attempts a USING(stream_id, arrival) WHERE a.expected IS NOT NULL")
def cas_expected_offset(spark, d):
    a = fx.attempts(spark, d)
    got = admit.admit_appends(a, ["arrival"]).select("stream_id", "arrival", "before")
    j = got.join(a.where("expected_offset is not null").select("stream_id", "arrival", "expected_offset"), ["stream_id", "arrival"])
    return j.select("stream_id", "arrival", (F.col("expected_offset") == F.col("before")).alias("matches"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority AS content_type, o_orderstatus='F' AS closed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
 SELECT r.o_orderkey, CASE WHEN r.k=1 THEN 'created' WHEN r.content_type=f.content_type AND r.closed=f.closed THEN 'exists' ELSE 'conflict' END AS status FROM r JOIN r f ON r.o_custkey=f.o_custkey AND f.k=1""")
def idempotent_create(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("content_type"), (F.col("o_orderstatus") == "F").alias("closed"))
    return admit.admit_creates(o, ["o_orderdate", "o_orderkey"], ["content_type", "closed"]).select("o_orderkey", "status")


@query(f"""WITH {STREAMS} SELECT stream_id, trim(split_part(lower(content_type),';',1))='application/json' AND (user_id%7=3) AND NOT closed AS same FROM streams""")
def config_match(spark, d):
    s = fx.streams(spark, d)
    null = lambda t: F.lit(None).cast(t)
    have = {"content_type": F.col("content_type"), "forked_from": null("string"), "fork_offset": null("string"), "fork_sub_offset": null("long"), "ttl_seconds": F.col("ttl_seconds"), "expires_at": F.col("expires_at"), "closed": F.col("closed")}
    ask = have | {"content_type": F.lit("application/json"), "ttl_seconds": F.lit(3 * 3600), "closed": null("boolean"), "fork_sub_offset": F.lit(0)}
    same = admit.config_matches(have, ask | {"forked_from": null("string")})
    # the request names its own expiry, so it does not inherit
    return s.select("stream_id", same.alias("same"))


# -- lineage -------------------------------------------------------------------------------------------------------


@query(f"WITH {FOREST} SELECT leaf AS stream_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, max(place) AS last FROM anc JOIN m ON m.id=anc.a AND (hi IS NULL OR place<=hi) GROUP BY 1")
def fork_chain_read(spark, d):
    f = cut(fx.forest(spark, d), "forest")
    got = lineage.chain_read(fx.forest_messages(spark, d, f), f)
    return got.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.max(F.substring("offset", 1, 16).cast("long")).alias("last"))


@query(f"WITH {FOREST} SELECT leaf AS stream_id, a AS ancestor, hi, depth FROM anc")
def fork_ancestry(spark, d):
    a = lineage.ancestry(fx.forest(spark, d))
    return a.select(F.col("leaf").cast("long").alias("stream_id"), F.col("ancestor").cast("long").alias("ancestor"), F.substring("hi", 1, 16).cast("long").alias("hi"), "depth")


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
 SELECT conv_id, CASE WHEN max(n)<conv_id%5 THEN 'bad-request' ELSE 'created' END AS status, count(*) FILTER (WHERE k<=conv_id%5) AS taken FROM t GROUP BY conv_id""")
def fork_sub_offset_json(spark, d):
    w = Window.partitionBy("conv_id")
    t = fx.table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("k"), F.count("*").over(w).alias("n"))
    return t.groupBy("conv_id").agg(F.when(F.max("n") < F.col("conv_id") % 5, "bad-request").otherwise("created").alias("status"), F.sum((F.col("k") <= F.col("conv_id") % 5).cast("long")).alias("taken"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text))>=doc_id%700 THEN lower(hex(encode(text)[1:doc_id%700])) END AS prefix FROM documents""")
def fork_sub_offset_bytes(spark, d):
    n = (F.col("doc_id") % 700).cast("int")
    return fx.table(spark, d, "documents").select("doc_id", F.lower(F.hex(lineage.byte_prefix(F.col("text").cast("binary"), n))).alias("prefix"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN o_orderkey%90 WHEN o_orderkey%5=0 THEN NULL WHEN o_custkey%2=0 THEN o_custkey%50 END AS ttl,
 CASE WHEN o_orderkey%3=0 THEN NULL WHEN o_orderkey%5=0 THEN '2030-01-01T00:00:00Z' WHEN o_custkey%2=0 THEN NULL ELSE '2031-01-01T00:00:00Z' END AS expires_at FROM orders""")
def fork_expiry_inherit(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ttl, at = lineage.fork_expiry(F.when(o % 3 == 0, o % 90), F.when(o % 5 == 0, "2030-01-01T00:00:00Z"), F.when(c % 2 == 0, c % 50), F.when(c % 2 != 0, "2031-01-01T00:00:00Z"))
    return fx.table(spark, d, "orders").select("o_orderkey", ttl.alias("ttl"), at.alias("expires_at"))


@query(f"""WITH {STREAMS}, r AS (SELECT o_orderkey, 'user/'||(o_custkey%200) AS src, CASE WHEN o_orderkey%10=0 THEN 'a=b' ELSE {off_sql("o_orderkey%120")} END AS wanted FROM orders)
 SELECT o_orderkey, CASE WHEN s.stream_id IS NULL THEN 'not-found' WHEN s.soft_deleted THEN 'conflict' WHEN o_orderkey%10=0 OR wanted>current_offset THEN 'bad-request' ELSE 'created' END AS status FROM r LEFT JOIN streams s ON r.src=s.stream_id""")
def fork_validate(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("user/"), F.col("o_custkey") % 200).alias("src"), F.when(F.col("o_orderkey") % 10 == 0, "a=b").otherwise(offsets.default_offset(F.col("o_orderkey") % 120)).alias("at"))
    j = o.join(fx.streams(spark, d).select("stream_id", "soft_deleted", "current_offset"), F.col("src") == F.col("stream_id"), "left")
    ok = offsets.is_valid(F.col("at")) & offsets.has_default_shape(F.col("at"))
    return j.select("o_orderkey", lineage.fork_verdict(F.col("stream_id").isNotNull(), F.col("soft_deleted"), ok, F.col("at"), F.col("current_offset")).alias("status"))


_EDGES = "s AS (SELECT c_custkey AS id, CASE WHEN c_custkey>=2 THEN c_custkey//2 END AS p, c_custkey%7=0 AS soft FROM customer)"


def _fork_records(spark, d):
    c = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(c.cast("string").alias("stream_id"), F.when(c >= 2, F.floor(c / 2).cast("string")).alias("forked_from"), F.when(c >= 2, F.lit(offsets.ZERO)).alias("fork_offset"), (c % 7 == 0).alias("soft_deleted"))


@query(f"WITH {_EDGES} SELECT CAST(s.id AS VARCHAR) AS stream_id, count(k.id) AS dependents FROM s LEFT JOIN s k ON k.p=s.id GROUP BY s.id")
def dependents_count(spark, d):
    return lineage.dependents(_fork_records(spark, d))


@query(f"WITH {_EDGES}, n AS (SELECT s.id, s.soft, count(k.id) AS n FROM s LEFT JOIN s k ON k.p=s.id GROUP BY ALL) SELECT CAST(id AS VARCHAR) AS stream_id, n AS dependents, CASE WHEN soft THEN 'gone' WHEN n>0 THEN 'retained-soft-deleted' ELSE 'purged' END AS status FROM n")
def delete_status(spark, d):
    return lineage.delete_status(_fork_records(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, t AS (SELECT id, p, soft OR id%3=0 AS soft FROM s), up AS (SELECT id, p FROM t WHERE NOT soft UNION SELECT t.id, t.p FROM up JOIN t ON t.id=up.p)
 SELECT CAST(t.id AS VARCHAR) AS stream_id, CASE WHEN NOT soft THEN 'visible' WHEN t.id IN (SELECT id FROM up) THEN 'retained-soft-deleted' ELSE 'purged' END AS status FROM t""")
def cascade_reclaim(spark, d):
    s = _fork_records(spark, d)
    return lineage.cascade(s, s.where(F.col("stream_id").cast("long") % 3 == 0).select("stream_id")).select("stream_id", "status")


# -- expiry --------------------------------------------------------------------------------------------------------

_NOW = 946_684_800_000  # 2000-01-01T00:00:00Z


@query(f"SELECT o_orderkey, epoch_ms(o_orderdate)+(o_orderkey%90)*86400000<={_NOW} AS expired FROM orders")
def expired_as_of(spark, d):
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 90) * 86_400_000
    return fx.table(spark, d, "orders").select("o_orderkey", expiry.expired(at, _NOW).alias("expired"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, epoch_ms(o_orderdate) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
 r AS (SELECT c, k, t+(c%400+30)*CAST(86400000 AS BIGINT) AS x FROM o WHERE k=1 UNION ALL SELECT o.c, o.k, o.t+(o.c%400+30)*CAST(86400000 AS BIGINT) FROM r JOIN o ON o.c=r.c AND o.k=r.k+1 AND o.t<r.x)
 SELECT c AS stream_id, max(x) AS expires_at_ms FROM r GROUP BY 1""")
def sliding_ttl(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("stream_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms"))
    born = o.groupBy("stream_id").agg(F.min("at_ms").alias("created_ms")).withColumn("ttl_seconds", (F.col("stream_id") % 400 + 30) * 86_400)
    return expiry.sliding(born, o)


# -- change logs ---------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id%9 WHEN 0 THEN NULL WHEN 1 THEN 'key' WHEN 2 THEN 'operation' WHEN 3 THEN 'unknown-type' WHEN 4 THEN 'value-missing' WHEN 5 THEN 'value-on-delete' WHEN 6 THEN NULL
 WHEN 7 THEN 'not-an-object' ELSE 'headers' END AS error FROM events""")
def change_validate(spark, d):
    v = F.array(*[F.lit(x) for x in (
        '{"type":"t","key":"k","value":null,"headers":{"operation":"insert"}}', '{"type":"t","key":"","value":1,"headers":{"operation":"insert"}}', '{"type":"t","key":"k","value":1,"headers":{"operation":"upsert"}}',
        '{"type":"g","key":"k","value":1,"headers":{"operation":"update"}}', '{"type":"t","key":"k","headers":{"operation":"update"}}', '{"type":"t","key":"k","value":1,"headers":{"operation":"delete"}}',
        '{"headers":{"control":"reset"}}', "[1]", '{"type":"t","key":"k","value":1,"headers":3}')])
    m = fx.table(spark, d, "events").select("event_id", F.get(v, (F.col("event_id") % 9).cast("int")).alias("m"))
    return m.select("event_id", changes.validate(F.col("m"), ["t"]).alias("error"))


@query(f"""WITH {CHANGES} SELECT scope, key, value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY "offset" DESC) AS k FROM changes WHERE control IS NULL) WHERE k=1 AND operation<>'delete'""")
def state_latest(spark, d):
    return changes.latest_state(fx.changes(spark, d).where("control is null"), ["scope", "key"]).select("scope", "key", "value")


@query(f"""WITH {CHANGES} SELECT scope, key, value FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY "offset" DESC) AS k FROM changes WHERE control IS NULL AND "offset"<={off_sql("300")}) WHERE k=1 AND operation<>'delete'""")
def state_as_of_offset(spark, d):
    return changes.latest_state(fx.changes(spark, d).where("control is null"), ["scope", "key"], until=f"{300:016d}_{0:016d}").select("scope", "key", "value")


@query(f"""WITH {CHANGES}, z AS (SELECT scope, max("offset") AS z FROM changes WHERE control='reset' GROUP BY 1) SELECT scope, key, value FROM (SELECT c.*, row_number() OVER (PARTITION BY c.scope, key ORDER BY c."offset" DESC) AS k
 FROM changes c LEFT JOIN z ON z.scope=c.scope WHERE control IS NULL AND (z IS NULL OR c."offset">z)) WHERE k=1 AND operation<>'delete'""")
def state_reset(spark, d):
    return changes.latest_state(changes.after_reset(fx.changes(spark, d), ["scope"]), ["scope", "key"]).select("scope", "key", "value")


@query(f"""WITH {CHANGES}, e AS (SELECT scope, max(st) AS z FROM (SELECT scope, (SELECT max("offset") FROM changes s WHERE s.scope=c.scope AND s.control='snapshot-start' AND s."offset"<c."offset") AS st FROM changes c WHERE control='snapshot-end') GROUP BY 1)
 SELECT scope, key, value FROM (SELECT c.*, row_number() OVER (PARTITION BY c.scope, key ORDER BY c."offset" DESC) AS k FROM changes c LEFT JOIN e ON e.scope=c.scope WHERE control IS NULL AND (z IS NULL OR c."offset">z)) WHERE k=1 AND operation<>'delete'""")
def state_snapshot(spark, d):
    return changes.latest_state(changes.after_snapshot(fx.changes(spark, d), ["scope"]), ["scope", "key"]).select("scope", "key", "value")


@query("""SELECT event_id, '{"type":"story","key":"'||event_id||'","value":'||props||',"headers":{"txid":"t'||user_id||'","operation":"insert"}}' AS message FROM events""")
def change_build(spark, d):
    e = fx.table(spark, d, "events")
    return e.select("event_id", changes.change(F.lit("story"), F.col("event_id").cast("string"), "insert", F.col("props"), txid=F.concat(F.lit("t"), F.col("user_id"))).alias("message"))


# -- folds and checkpoints -----------------------------------------------------------------------------------------


@query(f'WITH {MESSAGES} SELECT stream_id, CAST(sum(event_id) AS BIGINT) AS state, max("offset") AS cursor FROM messages GROUP BY 1')
def fold_sum(spark, d):
    return fold.sum_fold(fx.messages(spark, d), "event_id")


@query(f"""WITH {MESSAGES} SELECT stream_id, CAST(1000+coalesce(sum(event_id) FILTER (WHERE "offset">{off_sql("30")}),0) AS BIGINT) AS state, greatest(max("offset"),{off_sql("30")}) AS cursor FROM messages GROUP BY 1""")
def fold_resume_from_cursor(spark, d):
    m = fx.messages(spark, d)
    states = m.select("stream_id").distinct().select("stream_id", F.lit(1000).cast("long").alias("state"), F.lit(f"{30:016d}_{0:016d}").alias("cursor"))
    return fold.sum_fold(m, "event_id", states)


@query(f"""WITH {MESSAGES} SELECT stream_id, "offset", event_id, data FROM messages QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY "offset" DESC)=1""")
def checkpoint_last_wins(spark, d):
    return fold.last_wins(fx.messages(spark, d).select("stream_id", "offset", "event_id", "data"), ["stream_id"]).select("stream_id", "offset", "event_id", "data")


# -- views ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {CHANGES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY "offset" DESC) AS k FROM changes WHERE control IS NULL) WHERE k=1 AND operation<>'delete')
 SELECT scope, key, value, "offset" FROM l ORDER BY "offset" DESC, scope DESC, key DESC LIMIT 50""")
def newest_50(spark, d):
    live_ = changes.latest_state(fx.changes(spark, d).where("control is null"), ["scope", "key"])
    return views.top_n(live_, [F.desc("offset"), F.desc("scope"), F.desc("key")]).select("scope", "key", "value", "offset")


@query("SELECT o_custkey AS project, count(*) AS issues FROM orders GROUP BY 1")
def issues_by_project(spark, d):
    return fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("issues"))


@query("SELECT l_orderkey AS issue, string_agg(CAST(l_linenumber AS VARCHAR)||':'||CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS comments FROM lineitem GROUP BY 1")
def comments_by_issue(spark, d):
    c = views.ordered_children(fx.table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "c")
    return c.select(F.col("l_orderkey").alias("issue"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("comments"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey=7 AND o_orderstatus='O' ORDER BY o_orderdate DESC, o_orderkey DESC")
def visible_issues(spark, d):
    return fx.table(spark, d, "orders").where("o_custkey = 7 and o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%3<>0)")
def referential_violations(spark, d):
    projects = fx.table(spark, d, "customer").where("c_custkey % 3 <> 0")
    return views.missing_parents(fx.table(spark, d, "events").select("event_id", "user_id"), projects, "user_id", "c_custkey")


@query(f"""WITH {MESSAGES} SELECT event_id, CASE WHEN row_number() OVER w=1 THEN 'insert' WHEN lag(event_type) OVER w=event_type THEN 'unchanged' ELSE 'update' END AS delta FROM messages WINDOW w AS (PARTITION BY stream_id ORDER BY "offset")""")
def delta_classify(spark, d):
    return views.classify(fx.messages(spark, d), ["stream_id"], ["offset"], "event_type").select("event_id", "delta")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey%3=0 OR o_orderkey%5=0""")
def changed_rows(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "?").otherwise(F.col("o_orderstatus")))
    return views.changed(stored, o, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey")


@query("""WITH n AS (SELECT max(event_id) AS n FROM events), a AS (SELECT event_id, value FROM events, n WHERE event_id < n // 2 ORDER BY value DESC, event_id DESC LIMIT 50), b AS (SELECT event_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 50)
 SELECT event_id, CASE WHEN a.value IS NULL THEN 'enter' ELSE 'exit' END AS delta FROM a FULL JOIN b USING(event_id) WHERE a.value IS NULL OR b.value IS NULL""")
def topn_enter_exit(spark, d):
    """From the view of the first half of the log to that of the whole."""
    e = fx.table(spark, d, "events").select("event_id", "value")
    half = e.agg(F.floor(F.max("event_id") / 2).alias("half"))
    top = lambda df: views.top_n(df, [F.desc("value"), F.desc("event_id")])
    before = e.join(F.broadcast(half), F.col("event_id") < F.col("half")).select("event_id", "value")  # one row
    return views.view_delta(top(before), top(e), ["event_id"], "value").select("event_id", "delta")


# -- JSON lines ----------------------------------------------------------------------------------------------------


@query(f"WITH {MESSAGES} SELECT stream_id, \"offset\", \"timestamp\", CASE WHEN event_id%6=0 THEN 'text '||props WHEN event_id%2=0 THEN replace(data,'\": ','\":') ELSE data END AS data FROM messages")
def jsonl_roundtrip(spark, d):
    m = fx.messages(spark, d)
    m = m.withColumn("data", F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("text "), "props")).otherwise(F.col("data"))).withColumn("json_stream", F.col("event_id") % 2 == 0)
    lines = jsonl.encode(m.select("stream_id", "offset", "timestamp", "data", "json_stream", F.col("arrival").alias("line_no")))
    return jsonl.decode(lines.select("stream_id", "line", "line_no"), ["stream_id"]).select("stream_id", "offset", "timestamp", "data")


@query(f"""WITH {MESSAGES}, {STREAMS}, l AS (SELECT stream_id, {off_sql("(arrival+1)//2")} AS "offset", data, arrival FROM messages WHERE event_id%19<>0),
 w AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY stream_id, "offset" ORDER BY arrival DESC)=1) SELECT w.stream_id, w."offset", replace(w.data,'": ','":') AS data FROM w JOIN streams s USING(stream_id) WHERE w."offset"<=s.current_offset""")
def jsonl_tail_guard(spark, d):
    m = fx.messages(spark, d).withColumn("offset", offsets.default_offset(F.floor((F.col("arrival") + 1) / 2)))
    lines = jsonl.encode(m.withColumn("json_stream", F.lit(True)))
    lines = lines.select("stream_id", F.when(F.col("event_id") % 19 == 0, F.substring("line", 1, 9)).otherwise(F.col("line")).alias("line"), F.col("arrival").alias("line_no"))
    return scan.visible_tail(jsonl.decode(lines, ["stream_id"]), fx.streams(spark, d)).select("stream_id", "offset", "data")


# -- scalars -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(floor((epoch_ms(ts)-1728432000000)/20000) AS BIGINT) AS cursor, CASE WHEN event_id%1000>=floor((epoch_ms(ts)-1728432000000)/20000) THEN CAST(event_id%1000+90 AS BIGINT) ELSE CAST(floor((epoch_ms(ts)-1728432000000)/20000) AS BIGINT) END AS next_cursor FROM events""")
def live_cursor_bucket(spark, d):
    now = scalars.epoch_ms(F.col("ts").cast("timestamp"))
    return fx.table(spark, d, "events").select("event_id", offsets.live_cursor(now).alias("cursor"), offsets.live_cursor(now, F.col("event_id") % 1000, F.lit(0.5)).alias("next_cursor"))


@query("""SELECT event_id, CASE WHEN s<60 THEN s||'s ago' WHEN s<3600 THEN s//60||'m ago' WHEN s<86400 THEN s//3600||'h ago' ELSE s//86400||'d ago' END AS label FROM (SELECT event_id, event_id*event_id%200000 AS s FROM events)""")
def relative_time(spark, d):
    return fx.table(spark, d, "events").select("event_id", scalars.relative_time(F.col("event_id") * F.col("event_id") % 200_000).alias("label"))


@query("""SELECT event_id, CASE WHEN event_id%4=0 THEN NULL WHEN event_id%4=1 THEN event_id WHEN event_id%4=2 THEN 9007199254740991 ELSE NULL END AS n, upper('ab'||event_id) AS short FROM events""")
def id_helpers(spark, d):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("0"), i)).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, "9007199254740991").otherwise("9007199254740992")
    return fx.table(spark, d, "events").select("event_id", scalars.safe_integer(text).alias("n"), scalars.short_id(F.concat(F.lit("issue_ab"), i)).alias("short"))


# -- streaming twins -----------------------------------------------------------------------------------------------


def _event_stream(spark, d):
    return spark.readStream.schema(fx.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("""SELECT user_id, key, props AS value FROM (SELECT *, 'k'||(event_id%40) AS key, row_number() OVER (PARTITION BY user_id, event_id%40 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k=1 AND event_type<>'error'""")
def stream_state_latest(spark, d):
    e = _event_stream(spark, d).select("user_id", F.concat(F.lit("k"), F.col("event_id") % 40).alias("key"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("at"))
    return live.latest_state(e, ["user_id", "key"], "at", fx.shared_path(spark, "latest"))


_STREAM_PRODUCER = """WITH RECURSIVE a AS (SELECT 'user/'||user_id AS stream_id, event_id, event_id%3000//1000 AS pe, event_id%7%4 AS ps, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS event_id, '' AS status FROM (SELECT DISTINCT stream_id FROM a)
 UNION ALL SELECT stream_id, k, CASE WHEN st='accepted' THEN pe ELSE e END, CASE WHEN st='accepted' THEN ps ELSE s END, event_id, st FROM (
 SELECT a.stream_id, a.k, r.e, r.s, a.pe, a.ps, a.event_id, CASE WHEN r.e IS NULL THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'producer-gap' END WHEN pe<r.e THEN 'stale-epoch'
 WHEN pe>r.e THEN CASE WHEN ps=0 THEN 'accepted' ELSE 'invalid-epoch-seq' END WHEN ps<=r.s THEN 'duplicate' WHEN ps=r.s+1 THEN 'accepted' ELSE 'producer-gap' END AS st
 FROM r JOIN a ON a.stream_id=r.stream_id AND a.k=r.k+1) x) SELECT stream_id, event_id, status FROM r WHERE k>0"""


@query(_STREAM_PRODUCER)
def stream_producer_admission(spark, d):
    i = F.col("event_id")
    a = _event_stream(spark, d).select(F.concat(F.lit("user/"), F.col("user_id")).alias("stream_id"), F.lit("p").alias("producer_id"), "ts", "event_id", F.floor(i % 3000 / 1000).alias("producer_epoch"), (i % 7 % 4).alias("producer_seq"))
    return live.producer_admission(a, fx.shared_path(spark, "admission"))


@query("""SELECT event_id, 'enter' AS delta, CAST(0 AS BIGINT) AS batch FROM (SELECT event_id FROM events ORDER BY value DESC, event_id DESC LIMIT 50)""")
def stream_topn_delta(spark, d):
    e = _event_stream(spark, d).select("event_id", "value")
    got = live.top_n_deltas(e, ["event_id"], "value", [F.desc("value"), F.desc("event_id")], 50, fx.shared_path(spark, "top"))
    return got.select("event_id", "delta", "batch")


from tidelog.plans import log_queries, scalar_queries, state_queries  # noqa: E402, F401
