"""Queries of scalar functions, encodings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import media, offsets, scalars
from tidelog.operators import admit, create, expiry, scan
from tidelog.plans import fixtures as fx
from tidelog.plans.fixtures import STREAMS, off_sql
from tidelog.plans.registry import query


@query("SELECT event_id, CAST(CASE WHEN a<b THEN -1 WHEN a>b THEN 1 ELSE 0 END AS INTEGER) AS cmp FROM (SELECT event_id, event_type||(event_id%7) AS a, event_type||(user_id%7) AS b FROM events)")
def offset_compare(spark, d):
    key = lambda c: F.concat("event_type", (F.col(c) % 7).cast("string"))
    return fx.table(spark, d, "events").select("event_id", offsets.compare(key("event_id"), key("user_id")).alias("cmp"))


@query(f"SELECT event_id, CASE event_id%4 WHEN 0 THEN {off_sql('event_id')} ELSE '0000000000000000_0000000000000000' END AS start FROM events")
def live_read_start(spark, d):
    i = F.col("event_id")
    given = F.when(i % 4 == 0, offsets.default_offset(i)).when(i % 4 == 1, "0").when(i % 4 == 2, F.lit(None)).otherwise("-1")
    return fx.table(spark, d, "events").select("event_id", scan.live_start(given).alias("start"))


@query(r"""SELECT page_id, replace(replace(url_encode(url),'.','%2E'),'~','%7E') AS directory, url AS back,
 array_to_string(list_transform(string_split(url,'/'), lambda x: replace(replace(replace(replace(replace(url_encode(x),'%21','!'),'%2A','*'),'%27',''''),'%28','('),'%29',')')),'/') AS path,
 '__views/'||replace(replace(replace(replace(replace(url_encode(url),'%21','!'),'%2A','*'),'%27',''''),'%28','('),'%29',')')||'/checkpoint' AS checkpoint FROM (SELECT page_id, coalesce(url,'')||' (é~!*'')' AS url FROM pages)""")
def percent_encode(spark, d):
    u = F.concat(F.coalesce("url", F.lit("")), F.lit(" (é~!*')"))
    at = media.encoded_directory(u)
    return fx.table(spark, d, "pages").select("page_id", at.alias("directory"), media.decoded_directory(at).alias("back"), media.encoded_path(u).alias("path"), media.checkpoint_stream(u).alias("checkpoint"))


@query("SELECT event_id, CASE WHEN event_id%3=0 THEN 'user/'||user_id WHEN event_id%3=1 THEN '/v1xstreams/'||user_id ELSE '/other/'||user_id END AS stripped FROM events")
def path_prefix(spark, d):
    i, u = F.col("event_id") % 3, F.col("user_id")
    path = F.when(i == 0, F.concat(F.lit("/v1.streams/user/"), u)).when(i == 1, F.concat(F.lit("/v1xstreams/"), u)).otherwise(F.concat(F.lit("/other/"), u))
    return fx.table(spark, d, "events").select("event_id", media.strip_prefix(path, "/v1.streams").alias("stripped"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN epoch_ms(o_orderdate)+(o_orderkey%90)*1000 WHEN o_orderkey%3=1 THEN 1893456000000 END AS expires_at_ms FROM orders""")
def expiry_deadline(spark, d):
    o = F.col("o_orderkey")
    at = expiry.deadline(F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.when(o % 3 == 0, o % 90), F.when(o % 3 <= 1, "2030-01-01T00:00:00Z"))
    return fx.table(spark, d, "orders").select("o_orderkey", at.alias("expires_at_ms"))


_B36 = "||".join(f"substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST(('0x'||substring(h,{2 * i + 1},2)) AS INTEGER)%36+1, 1)" for i in range(10))


@query(f"""SELECT event_id, 'issue_'||substring(h,1,8) AS id, {_B36} AS code, event_id%5 IN (0,1) AS valid, CASE WHEN event_id%3=0 THEN 'Untitled issue' ELSE event_type END AS title,
 CASE WHEN event_id%3=0 THEN 'you' WHEN event_id%3=1 THEN 'you' ELSE event_type END AS author FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events)""")
def identifiers(spark, d):
    i = F.col("event_id")
    h = F.md5(i.cast("string").cast("binary"))
    name = F.when(i % 5 == 0, "main").when(i % 5 == 1, F.concat(F.lit("0a-"), i)).when(i % 5 == 2, F.concat(F.lit("-"), i)).when(i % 5 == 3, F.repeat(F.lit("a"), 65)).otherwise("Main")
    padded = F.concat(F.lit("  "), "event_type", F.lit(" "))
    return fx.table(spark, d, "events").select(
        "event_id", scalars.prefixed_id("issue", h).alias("id"), scalars.base36_id(F.unhex(h)).alias("code"), scalars.valid_workspace(name).alias("valid"),
        scalars.trimmed_or(F.when(i % 3 != 0, padded), "Untitled issue").alias("title"), scalars.trimmed_or(F.when(i % 3 == 2, padded).when(i % 3 == 1, "  "), "you", keep_empty=False).alias("author"),
    )


@query("SELECT event_id, CASE event_id%3 WHEN 0 THEN 'k'||event_id END AS key FROM events")
def key_from_value(spark, d):
    i = F.col("event_id").cast("string")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"id":"k'), i, F.lit('","n":1}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"id":'), i, F.lit("}"))).otherwise(F.lit('{"n":1}'))
    return fx.table(spark, d, "events").select("event_id", scalars.key_of(v, "id").alias("key"))


@query(f"WITH {STREAMS} SELECT stream_id, CASE WHEN user_id%2=0 THEN 'seq' END AS last_seq, CASE WHEN user_id%3=0 THEN true ELSE closed END AS closed, CASE WHEN user_id%4=0 THEN {off_sql('user_id')} ELSE current_offset END AS current_offset FROM streams")
def record_patch(spark, d):
    k, null = F.col("user_id"), F.lit(None)
    return fx.streams(spark, d).select(
        "stream_id", scalars.merged(F.when(k % 2 == 0, "seq"), null.cast("string")).alias("last_seq"), scalars.merged(F.when(k % 3 == 0, True), F.col("closed")).alias("closed"),
        scalars.merged(F.when(k % 4 == 0, offsets.default_offset(k)), F.col("current_offset")).alias("current_offset"),
    )


@query("""SELECT * FROM (VALUES ('appended',204),('duplicate',204),('not-found',404),('gone',410),('conflict:closed',409),('conflict:expected-offset',409),('conflict:content-type',409),
 ('conflict:sequence',409),('busy',503),('stale-epoch',403),('producer-gap',409),('invalid-epoch-seq',400),('bad-request',400)) t(status, code)""")
def status_code_map(spark, d):
    return admit.status_codes(spark)


def _talk(spark, d):
    """Messages of conversations as bytes in order, with a content type by conversation."""
    i = F.col("conv_id")
    kind = F.when(i % 3 == 0, "application/json").when(i % 3 == 1, "text/plain; charset=utf-8").otherwise(F.lit(None).cast("string"))
    text = F.when(i % 3 == 0, F.concat(F.lit("["), "turn", F.lit("]"))).otherwise(F.coalesce("text", F.lit("")))
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", kind.alias("content_type"), text.cast("binary").alias("data"))
    return c.groupBy("conv_id", "content_type").agg(F.sort_array(F.collect_list(F.struct("turn", "data"))).alias("m")).select("conv_id", "content_type", F.col("m.data").alias("m"))


_TALK = """t AS (SELECT conv_id, turn, coalesce(text,'') AS text FROM conversations),
g AS (SELECT conv_id, list(text ORDER BY turn, text) AS texts, list('['||turn||']' ORDER BY turn) AS items, string_agg(text, '' ORDER BY turn, text) AS whole FROM t GROUP BY 1)"""


@query(f"""WITH {_TALK} SELECT conv_id, CASE conv_id%3 WHEN 0 THEN 'json' WHEN 1 THEN 'text' ELSE 'bytes' END AS kind,
 CASE conv_id%3 WHEN 0 THEN '['||array_to_string(items,',')||']' WHEN 1 THEN whole ELSE lower(hex(encode(whole))) END AS body FROM g""")
def batch_encoding(spark, d):
    return _talk(spark, d).select("conv_id", media.batch_kind(F.col("content_type")).alias("kind"), media.batch_body(F.col("content_type"), F.col("m")).alias("body"))


@query(f"""WITH {_TALK} SELECT conv_id, 'event: data'||chr(10)||CASE conv_id%3 WHEN 0 THEN 'data:['||chr(10)||'data:'||array_to_string(items, ','||chr(10)||'data:')||chr(10)||'data:]'
 WHEN 1 THEN 'data:'||regexp_replace(whole, '\\r\\n|\\r|\\n', chr(10)||'data:', 'g') ELSE 'data:'||to_base64(encode(whole)) END||chr(10)||chr(10) AS data,
 'event: control'||chr(10)||'data:{{"streamNextOffset":"'||{off_sql('conv_id')}||CASE WHEN conv_id%2=0 THEN '","streamClosed":true}}' ELSE '","streamCursor":"'||conv_id||'"'||CASE WHEN conv_id%5=0 THEN ',"upToDate":true' ELSE '' END||'}}' END||chr(10)||chr(10) AS control FROM g""")
def event_stream(spark, d):
    i = F.col("conv_id")
    return _talk(spark, d).select("conv_id", media.data_event(F.col("content_type"), F.col("m")).alias("data"), media.control_event(offsets.default_offset(i), i, i % 5 == 0, i % 2 == 0).alias("control"))


@query("""SELECT event_id, CASE event_id%4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS n, CASE event_id%4 WHEN 0 THEN lower(hex(encode(props))) WHEN 2 THEN lower(hex(encode('raw '||props))) END AS first FROM
 (SELECT event_id, replace(props, ': ', ':') AS props FROM events)""")
def framed_bodies(spark, d):
    i = F.col("event_id") % 4
    body = F.when(i == 0, F.concat(F.lit("["), "props", F.lit(",1]"))).when(i == 1, F.lit(None).cast("string")).when(i == 2, F.concat(F.lit("raw "), F.replace("props", F.lit(": "), F.lit(":")))).otherwise("{bad")
    items = create.framed_bytes(body.cast("binary"), F.when(i == 2, "text/plain").otherwise("application/json"))
    return fx.table(spark, d, "events").select("event_id", F.when(items.isNotNull(), F.size(items)).alias("n"), F.lower(F.hex(F.get(items, F.lit(0)))).alias("first"))


@query("SELECT event_id, lower(hex(encode('{\"type\":\"'||event_type||'\",\"p\":'||props||'}'))) AS raw FROM events")
def raw_read(spark, d):
    m = fx.messages(spark, d)
    return m.select("event_id", F.lower(F.hex(F.col("data").cast("binary"))).alias("raw"))
