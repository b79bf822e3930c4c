"""Golden cases of the log's rules."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import media, offsets, scalars
from tidelog.operators import admit, changes, fold, lineage, scan, views
from tidelog.sources import jsonl, logtable

Z = offsets.ZERO


def off(n):
    return f"{n:016d}_{0:016d}"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "state,epoch,seq,want",
    [(None, 0, 0, "accepted"), (None, 3, 1, "producer-gap"), ((2, 5), 1, 9, "stale-epoch"), ((2, 5), 3, 0, "accepted"), ((2, 5), 3, 1, "invalid-epoch-seq"), ((2, 5), 2, 5, "duplicate"), ((2, 5), 2, 0, "duplicate"), ((2, 5), 2, 6, "accepted"), ((2, 5), 2, 7, "producer-gap")],
)
def test_producer_matrix(state, epoch, seq, want):
    assert admit.producer_decision(state, epoch, seq) == want


def test_window_contract(spark):
    m = spark.createDataFrame([("s", off(i), x) for i, x in enumerate("abcd", 1)], "stream_id string, offset string, data string")
    read = lambda **k: [r.data for r in scan.range_scan(m, "s", **k).collect()]
    assert read(after=off(1)) == ["b", "c", "d"]
    assert read(until=off(3)) == ["a", "b", "c"]
    assert read(after=off(1), until=off(3), limit=1) == ["b"]
    assert read(after="") == ["a", "b", "c", "d"]
    assert read(limit=0) == []


ROW = dict(stream_id="s", n_messages=1, type_ok=True, seq=None, producer_id=None, producer_epoch=None, producer_seq=None, close=False, expected_offset=None)
SCHEMA = "stream_id string, arrival long, n_messages long, type_ok boolean, seq string, producer_id string, producer_epoch long, producer_seq long, close boolean, expected_offset string"


def admitted(spark, *rows):
    df = spark.createDataFrame([ROW | {"arrival": i} | r for i, r in enumerate(rows)], SCHEMA)
    return [(r.status, r.tail) for r in admit.admit_appends(df, ["arrival"]).orderBy("arrival").collect()]


def test_append_rules_in_order(spark):
    p = lambda e, s, **k: dict(producer_id="p", producer_epoch=e, producer_seq=s) | k
    assert admitted(spark, p(1, 0), p(1, 0)) == [("appended", off(1)), ("duplicate", off(1))]
    assert [s for s, _ in admitted(spark, p(2, 0), p(1, 0))] == ["appended", "stale-epoch"]
    # a duplicate is acknowledged even on a closed stream; a new append is not
    assert [s for s, _ in admitted(spark, p(0, 0, close=True), p(0, 0), {}, dict(close=True, n_messages=0))] == ["appended", "duplicate", "conflict:closed", "appended"]
    assert [s for s, _ in admitted(spark, {}, dict(expected_offset=Z), dict(expected_offset=off(1)))] == ["appended", "conflict:expected-offset", "appended"]
    assert [s for s, _ in admitted(spark, dict(seq="b"), dict(seq="a"), dict(seq=""), dict(type_ok=False, seq="a"))] == ["appended", "conflict:sequence", "appended", "conflict:content-type"]
    # close-only keeps the sequence it brings
    assert [s for s, _ in admitted(spark, dict(n_messages=0), dict(n_messages=2))] == ["appended", "appended"]


def test_framing(spark):
    f = lambda body, js=True: one(spark, media.framed(F.lit(body), F.lit(js)))
    assert f('{"b":1,"a":2}') == ['{"b":1,"a":2}']
    assert f('[{"b":1,"a":2}, 3, "x", null, [1]]') == ['{"b":1,"a":2}', "3", '"x"', "null", "[1]"]
    assert f("[]") == [] and f("{bad") is None and f("{bad", False) == ["{bad"]


def test_directory_codec():
    for s in ("a/b c", "ü-1_", "..", "%41"):
        d = media.directory_of(s)
        assert "/" not in d and "." not in d and media.stream_of(d) == s
    with pytest.raises(ValueError):
        media.directory_of("")


def test_scalars(spark):
    v = lambda x: one(spark, scalars.safe_integer(F.lit(x)))
    assert [v("0"), v("07"), v("9007199254740991"), v("9007199254740992"), v("x"), v("99999999999999999999")] == [0, None, 2**53 - 1, None, None, None]
    assert one(spark, scalars.relative_time(F.lit(59))) == "59s ago" and one(spark, scalars.relative_time(F.lit(90_000))) == "1d ago"
    assert one(spark, offsets.default_offset(F.lit(10**16))) is None


def test_live_cursor_rounds_the_clock_as_its_sql_does(spark, tmp_path):
    import duckdb

    from tidelog.plans import catalog

    times = [f"{day} 00:00:{edge}" for day in ("2024-01-01", "2024-10-09", "2024-10-10", "1960-01-01", "1970-01-01", "9999-12-31") for edge in ("19.999499", "19.999500", "19.999999", "20.000000", "20.000499", "20.000500")]
    times += ["1969-12-31 23:59:59.999499", "1969-12-31 23:59:59.999500", "1969-12-31 23:59:59.999501", None]
    rows = [(n if n % 5 else None, t) for n, t in enumerate(times * 2)]
    spark.createDataFrame(rows, "event_id long, ts string").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = [tuple(r) for r in catalog.live_cursor_bucket(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(db.sql(catalog.ORACLE_SQL["live_cursor_bucket"]).fetchall(), key=str)
    ms = lambda t: one(spark, scalars.epoch_ms(F.lit(t).cast("timestamp")))
    assert [ms(f"1970-01-01 00:00:00.{us}") for us in ("000499", "000500", "001499", "001500")] == [0, 1, 1, 2]
    assert [ms(f"1969-12-31 23:59:59.{us}") for us in ("999501", "999500", "998501", "998500")] == [0, -1, -1, -2] and ms(None) is None


def test_change_sequence(spark):
    b = lambda *a, **k: one(spark, changes.change(*a, **k))
    assert b(F.lit("user"), F.lit("u1"), "insert", F.lit('{"id":"u1"}'), txid=F.lit("t1")) == '{"type":"user","key":"u1","value":{"id":"u1"},"headers":{"txid":"t1","operation":"insert"}}'
    assert b(F.lit("user"), F.lit("u1"), "delete", old_value=F.lit("1")) == '{"type":"user","key":"u1","old_value":1,"headers":{"operation":"delete"}}'
    assert one(spark, changes.control("snapshot-start", F.lit("2_0"))) == '{"headers":{"control":"snapshot-start","offset":"2_0"}}'


def test_fold_and_resume(spark):
    m = spark.createDataFrame([("s", off(i + 1), v) for i, v in enumerate([1, 2, 4, 8])], "stream_id string, offset string, v long")
    assert fold.sum_fold(m, "v").first()["state"] == 15
    st = spark.createDataFrame([("s", 10, off(2))], "stream_id string, state long, cursor string")
    assert tuple(fold.sum_fold(m, "v", st).first())[1:] == (22, off(4))
    st = spark.createDataFrame([("s", 10, off(4)), ("t", 5, off(1))], "stream_id string, state long, cursor string")
    assert {r.stream_id: (r.state, r.cursor) for r in fold.sum_fold(m, "v", st).collect()} == {"s": (10, off(4)), "t": (5, off(1))}


def test_cascade(spark):
    s = spark.createDataFrame([("a", None, None, True), ("b", "a", Z, False), ("c", None, None, False)], "stream_id string, forked_from string, fork_offset string, soft_deleted boolean")
    got = lambda *ids: {r.stream_id: r.status for r in lineage.cascade(s, spark.createDataFrame([(i,) for i in ids], "stream_id string")).collect()}
    assert got("c") == {"a": "retained-soft-deleted", "b": "visible", "c": "purged"}
    assert got("b") == {"a": "purged", "b": "purged", "c": "visible"}


def test_fork_chains_of_any_length(spark):
    n = 150
    s = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None, off(9 + i) if i else None, False) for i in range(n)], "stream_id string, forked_from string, fork_offset string, soft_deleted boolean")
    m = spark.createDataFrame([(f"s{i}", off(k)) for i in range(n) for k in (5, 500)], "stream_id string, offset string")
    got = {(r.origin, r.offset) for r in lineage.chain_read(m, s).where(f"stream_id = 's{n - 1}'").collect()}
    assert got == {(f"s{i}", off(5)) for i in range(n)} | {(f"s{n - 1}", off(500))}
    gone = spark.createDataFrame([(f"s{i}",) for i in range(n - 1)], "stream_id string")
    assert {r.status for r in lineage.cascade(s, gone).where("soft_deleted").collect()} == {"retained-soft-deleted"}
    ring = spark.createDataFrame([("a", "b", Z), ("b", "a", Z)], "stream_id string, forked_from string, fork_offset string")
    with pytest.raises(ValueError):
        lineage.ancestry(ring)


def test_jsonl_skips_bad_lines_and_keeps_the_last(spark, tmp_path):
    f = tmp_path / "m.jsonl"
    f.write_text(f'{{"offset":"{off(1)}","timestamp":1,"json":{{"a":1}}}}\nbad\n{{"offset":"{off(1)}","timestamp":2,"json":{{"a":2}}}}\n{{"offset":"{off(2)}","timestamp":3,"b64":"aGk="}}\n')
    got = jsonl.decode(jsonl.read_file(spark, str(f)), [])
    assert [(r.timestamp, r.data) for r in got.orderBy("offset").collect()] == [(2, '{"a":2}'), (3, "hi")]


def test_log_table_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("s", off(i), i, bytes([i])) for i in range(5)], logtable.SCHEMA)
    logtable.write(m, str(tmp_path / "log"))
    assert sorted(r.timestamp for r in logtable.read(spark, str(tmp_path / "log")).collect()) == list(range(5))


def test_tail_stream_gives_what_is_new(spark, tmp_path):
    path = str(tmp_path / "log")
    put = lambda *at: logtable.write(spark.createDataFrame([("s", off(i), i, bytes([i])) for i in at], logtable.SCHEMA), path)
    seen = []
    drain = lambda: logtable.tail_stream(spark, path).writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.timestamp for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    put(1, 2)
    drain()
    put(3)
    drain()
    assert seen == [[1, 2], [3]]


def test_view_delta(spark):
    a, b = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "x"), (2, "y"), (3, "z")], [(2, "y"), (3, "w"), (4, "n")]))
    assert {(r.k, r.delta) for r in views.view_delta(a, b, ["k"], "v").collect()} == {(1, "exit"), (3, "update"), (4, "enter")}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
