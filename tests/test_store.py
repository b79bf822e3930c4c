"""The log store: commits, races, hooks, waiting, expiry; streams that stop and go on."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.functions import offsets
from tidelog.operators import create, fold, jsonlayer, lineage
from tidelog.sources import jsonl, store
from tidelog.sources.store import CheckpointStore, LogStore, NotSupported
from tidelog.streaming import live

T0 = 946_684_800_000
ASK = "stream_id string, arrival long, content_type string, ttl_seconds long, expires_at string, closed boolean, body binary, forked_from string, fork_offset string, fork_sub_offset long"
PUT = "stream_id string, arrival long, body binary, content_type string, seq string, producer_id string, producer_epoch long, producer_seq long, close boolean, expected_offset string"


def at(n):
    return f"{n:016d}_{0:016d}"


def ask(spark, *rows):
    return spark.createDataFrame([(i, n, t, ttl, None, closed, b, f, fo, so) for n, (i, t, ttl, closed, b, f, fo, so) in enumerate(rows)], ASK)


def put(spark, *rows):
    return spark.createDataFrame([(i, n, b, t, s, p, e, q, c, x) for n, (i, b, t, s, p, e, q, c, x) in enumerate(rows)], PUT)


def made(spark, path, **kw):
    log = LogStore(spark, str(path), **kw)
    log.create(ask(spark, ("a", "application/json", None, False, b"[1,2]", None, None, None), ("b", "text/plain", 10, False, None, None, None, None)), T0)
    return log


def answers(df):
    return [r.status for r in df.orderBy("arrival").collect()]


def test_append_rules_over_stored_state(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    text = "text/plain"
    got = log.append(put(
        spark, ("none", b"x", text, None, None, None, None, False, None), ("a", b"3", "application/json", "m", "p", 0, 0, False, at(2)), ("a", b"3", "application/json", None, "p", 0, 0, False, None), ("a", b"{", "application/json", None, None, None, None, False, None),
        ("a", b"4", "application/json", "l", None, None, None, False, None), ("a", b"4", text, None, None, None, None, False, None), ("a", b"4", "application/json", None, None, None, None, False, at(2)), ("a", None, None, None, None, None, None, True, at(1)),
        ("a", None, None, None, None, None, None, True, at(3)), ("a", None, None, None, None, None, None, True, at(0)), ("a", b"[]", "application/json", None, None, None, None, True, None), ("b", b"end", text, None, None, None, None, True, None),
    ), T0 + 1)
    want = ["not-found", "appended", "duplicate", "bad-request", "conflict:sequence", "conflict:content-type", "conflict:expected-offset", "conflict:expected-offset", "appended", "appended", "conflict:closed", "appended"]
    assert answers(got) == want
    snap = log.snapshot()
    assert [(r.offset, bytes(r.data)) for r in snap.messages.where("stream_id = 'a'").orderBy("offset").collect()] == [(at(1), b"1"), (at(2), b"2"), (at(3), b"3")]
    assert [tuple(r) for r in snap.producers.collect()] == [("a", "p", 0, 0)]
    r = {x.stream_id: x for x in snap.records.collect()}
    assert (r["a"].closed, r["a"].last_seq, r["a"].closed_at, r["b"].expires_at_ms, r["b"].current_offset) == (True, "m", T0 + 1, T0 + 10_001, at(1))
    # the state is taken up by the next batch
    assert answers(log.append(put(spark, ("a", b"9", "application/json", None, "p", 0, 0, False, None), ("a", b"9", "application/json", None, "p", 0, 2, False, None)), T0 + 2)) == ["duplicate", "producer-gap"]


def test_writers_race_and_none_is_lost(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    got = {}

    def write(n):
        got[n] = answers(LogStore(spark, log.folder).append(put(spark, ("a", str(n).encode(), "application/json", None, None, None, None, False, None)), T0))

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(v == ["appended"] for v in got.values()) and log.version() == 4
    m = log.snapshot().messages.where("stream_id = 'a'").orderBy("offset").collect()
    assert [r.offset for r in m] == [at(n) for n in range(1, 6)] and sorted(bytes(r.data) for r in m[2:]) == [b"0", b"1", b"2"]


def test_a_writer_that_never_wins_is_busy_and_writes_nothing(spark, tmp_path, monkeypatch):
    log = made(spark, tmp_path / "log")
    monkeypatch.setattr(store, "ATTEMPTS", 2)
    monkeypatch.setattr(log, "_put", lambda version, tables: False)
    monkeypatch.setattr(log, "version", iter([1, 9] * 9).__next__)
    one = put(spark, ("a", b"1", "application/json", None, None, None, None, False, None), ("a", b"1", "application/json", None, None, None, None, False, at(2)))
    assert answers(log.append(one, T0)) == ["busy", "conflict:expected-offset"]
    assert LogStore(spark, log.folder).version() == 1


def test_a_dead_writer_holds_nobody_up(spark, tmp_path, monkeypatch):
    log = made(spark, tmp_path / "log")
    monkeypatch.setattr(store, "STALE_S", 0.2)
    (tmp_path / "log" / "versions" / f"{2:020d}.lock").write_text("")  # it took the version and died
    assert answers(log.append(put(spark, ("a", b"3", "application/json", None, None, None, None, False, None)), T0)) == ["appended"]
    assert log.version() == 2 and log._put(2, {}) is False


def test_compaction_keeps_what_is_there(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    log.append(put(spark, ("a", b"3", "application/json", None, None, None, None, False, None), ("b", b"x", "text/plain", None, None, None, None, False, None)), T0)
    log.delete(spark.createDataFrame([("b",)], "stream_id string"), T0)
    before = sorted(map(str, log.snapshot().messages.collect()))
    log.compact()
    snap = log.snapshot()
    assert sorted(map(str, snap.messages.collect())) == before and len(snap.tables["messages"]) == 1 and snap.stored.count() == 3


def test_hooks_see_commits_and_their_errors_stay_theirs(spark, tmp_path):
    log, seen = made(spark, tmp_path / "log"), []

    def bad(events):
        raise RuntimeError

    log.on_commit(bad)
    off = log.on_commit(lambda events: seen.append(sorted((r.stream_id, r.offset, r.closed) for r in events.collect())))
    one = lambda: put(spark, ("a", b"5", "application/json", None, None, None, None, False, None))
    events = []
    log.on_commit(lambda e: events.append(e))
    log.append(one(), T0)
    off()
    log.append(one(), T0)
    assert seen == [[("a", at(3), False)]]
    # fan-in of commits into another stream
    log.create(ask(spark, ("feed", "application/json", None, False, None, None, None, None)), T0)
    log.append(store.fan_in(events[0], "a", "feed"), T0)
    m = log.snapshot().messages.where("stream_id = 'feed'").collect()
    assert [bytes(r.data).decode() for r in m] == [f'{{"stream_id":"a","offset":"{at(3)}","closed":false,"soft_deleted":false}}']


def test_waiting_is_level_triggered(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    assert log.await_change(0, 10_000) == "changed"  # it happened before the wait
    assert log.await_change(1, 50) == "timeout"
    stop = threading.Event()
    stop.set()
    assert log.await_change(1, 60_000, abort=stop) == "timeout"
    t = threading.Timer(0.3, lambda: log.append(put(spark, ("a", b"5", "application/json", None, None, None, None, False, None)), T0))
    t.start()
    assert log.await_change(1, 60_000) == "changed"
    t.join()


def test_expiry_and_incarnations(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    log.append(put(spark, ("b", b"old", "text/plain", None, "p", 0, 0, False, None)), T0)
    late = T0 + 60_000
    assert answers(log.append(put(spark, ("b", b"x", "text/plain", None, None, None, None, False, None)), late)) == ["not-found"]  # lazily expired, and purged by the commit
    assert answers(log.create(ask(spark, ("b", "text/plain", None, False, b"new", None, None, None)), late)) == ["created"]
    snap = log.snapshot()
    assert [(r.stream_id, bytes(r.data)) for r in snap.messages.where("stream_id = 'b'").collect()] == [("b", b"new")] and snap.producers.count() == 0


def test_forks_keep_their_source(spark, tmp_path):
    log = made(spark, tmp_path / "log")
    got = log.create(ask(
        spark, ("f", None, None, False, b"9", "a", at(1), None), ("g", None, None, False, None, "a", at(7), None), ("h", None, None, False, None, "none", None, None), ("i", "text/plain", None, False, None, "a", None, None), ("j", None, None, True, None, "a", at(0), 1),
    ), T0)
    assert answers(got) == ["created", "bad-request", "not-found", "conflict", "created"]
    assert [r.status for r in log.delete(spark.createDataFrame([("a",), ("x",)], "stream_id string"), T0).orderBy("stream_id").collect()] == ["retained-soft-deleted", "not-found"]
    a, m = log.read(spark.createDataFrame([("f", None), ("j", at(0)), ("a", None)], "stream_id string, from string"), T0)
    assert {r.stream_id: (r.status, r.n_messages, r.next_offset) for r in a.collect()} == {"f": ("ok", 2, at(2)), "j": ("ok", 1, at(1)), "a": ("gone", 0, None)}
    assert [(r.stream_id, r.offset, bytes(r.data)) for r in m.collect()] == [("f", at(1), b"1"), ("f", at(2), b"9"), ("j", at(1), b"1")]
    log.delete(spark.createDataFrame([("f",), ("j",)], "stream_id string"), T0)
    assert [r.stream_id for r in log.snapshot().records.collect()] == ["b"]


def test_capabilities_and_schemes(spark, tmp_path):
    with pytest.raises(NotSupported):
        LogStore(spark, str(tmp_path / "ro"), capabilities=frozenset({"read"})).append(put(spark), T0)
    with pytest.raises(ValueError):
        offsets.checked(offsets.PaddedOffsets(",", 4))
    log = made(spark, tmp_path / "log", scheme=offsets.PaddedOffsets("v", 6))
    log.append(put(spark, ("a", b"[7,8]", "application/json", None, None, None, None, False, "v000002")), T0)
    assert [r.offset for r in log.snapshot().messages.where("stream_id = 'a'").orderBy("offset").collect()] == [f"v{n:06d}" for n in range(1, 5)]


def test_checkpoints(spark, tmp_path):
    log = LogStore(spark, str(tmp_path / "log"))
    keep = CheckpointStore(log)
    views = spark.createDataFrame([("v/1",), ("w",)], "view_id string")
    save = lambda n: keep.save(spark.createDataFrame([("v/1", {"s": at(n)}, at(n), str(n))], "view_id string, cursors map<string,string>, applied_through string, snapshot string"), T0)
    save(5)
    save(3)  # the last one wins, whatever its cursor
    assert [(r.view_id, r.cursors, r.snapshot) for r in keep.load(views).collect()] == [("v/1", {"s": at(3)}, "3")]
    sid = keep._ids(views).where("view_id = 'v/1'").first().stream_id
    assert sid == "__views/v%2F1/checkpoint"
    log.append(put(spark, (sid, b'{"cursors":7}', "application/json", None, None, None, None, False, None)), T0)
    with pytest.raises(Exception, match="malformed checkpoint"):
        keep.load(views).collect()


def test_json_streams(spark, tmp_path):
    codec = jsonlayer.JsonCodec("k long, t string", check=lambda v: v["k"] > 0)
    log = LogStore(spark, str(tmp_path / "log"))
    values = spark.createDataFrame([("s", 0, (1, "a")), ("s", 1, (2, "b"))], "stream_id string, arrival long, value struct<k:long,t:string>")
    rest = lambda df: df.selectExpr("*", "cast(null as string) seq", "cast(null as string) producer_id", "cast(null as long) producer_epoch", "cast(null as long) producer_seq", "false close", "cast(null as string) expected_offset")
    first = codec.encode(F.col("value")).cast("binary")
    asked = values.where("arrival = 0").select("stream_id", "arrival", F.lit("application/json").alias("content_type"), F.lit(None).cast("long").alias("ttl_seconds"), F.lit(None).cast("string").alias("expires_at"), F.lit(False).alias("closed"), first.alias("body"), F.lit(None).cast("string").alias("forked_from"), F.lit(None).cast("string").alias("fork_offset"), F.lit(None).cast("long").alias("fork_sub_offset"))
    assert answers(log.create(asked, T0)) == ["created"]
    assert answers(log.append(rest(jsonlayer.appends(values.where("arrival = 1"), codec)), T0)) == ["appended"]
    raw = spark.createDataFrame([("s", 2, '[{"k":3},{"k":4}]')], "stream_id string, arrival long, json string")
    assert answers(log.append(rest(jsonlayer.raw_appends(raw)), T0)) == ["appended"]
    got = jsonlayer.read(log.snapshot().messages, codec).first()
    assert (got.status, [(v.k, v.t) for v in got["values"]]) == ("ok", [(1, "a"), (2, "b"), (3, None), (4, None)])
    log.append(rest(jsonlayer.raw_appends(raw.withColumn("json", F.lit('{"k":-1}')))), T0)
    got = jsonlayer.read(log.snapshot().messages, codec).first()
    assert (got.status, got.offset, got["values"]) == ("invalid-json", at(5), None)


def test_long_chains_and_missing_ancestors(spark):
    rows = [("0", None, None)] + [(str(i), str(i - 1), at(1)) for i in range(1, 200)]
    s = spark.createDataFrame(rows, "stream_id string, forked_from string, fork_offset string")
    m = spark.createDataFrame([(str(i), at(1), i) for i in range(200)], "stream_id string, offset string, n long")
    assert lineage.chain_read(m, s.where("stream_id = '199'"), others=s).count() == 200
    # a purged stream cuts what lies above it, and its rows are not read
    left = s.where("stream_id <> '150'")
    assert lineage.chain_read(m, left.where("stream_id = '199'"), others=left).count() == 49


def test_json_lines_keep_bytes_and_order(spark, tmp_path):
    rows = [("s", at(1), 1, b"\xff\x00", True), ("s", at(2), 2, b'{"a": 1}', True), ("s", at(3), 3, "é".encode(), False)]
    df = spark.createDataFrame(rows, "stream_id string, offset string, timestamp long, data binary, json_stream boolean")
    lines = [r.line for r in jsonl.encode(df).orderBy("offset").collect()]
    f = tmp_path / "s.jsonl"
    f.write_text("\n".join([*lines, "{broken", lines[0].replace('"timestamp":1', '"timestamp":9')]) + "\n")
    got = jsonl.decode(jsonl.read_file(spark, str(f)), [], binary=True).orderBy("offset").collect()
    assert [(r.offset, r.timestamp, bytes(r.data)) for r in got] == [(at(1), 9, b"\xff\x00"), (at(2), 2, b'{"a":1}'), (at(3), 3, "é".encode())]


def batches(spark, path, *parts):
    for p in parts:
        spark.createDataFrame(p, "k string, v long, at long, operation string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k string, v long, at long, operation string").option("maxFilesPerTrigger", 1).parquet(path)


def test_top_n_follows_updates_deletes_and_restarts(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    order = [F.desc("v"), F.desc("k")]
    rows = batches(spark, src, [("a", 10, 1, "insert"), ("b", 20, 2, "insert"), ("c", 5, 3, "insert")], [("a", 30, 4, "update")])
    live.top_n_deltas(rows, ["k"], "v", order, 2, path, arrival="at").collect()
    rows = batches(spark, src, [("b", 0, 5, "delete")], [("a", 1, 6, "update"), ("d", 2, 7, "insert")])  # the query goes on where it stopped
    got = {(r.batch, r.k, r.delta, r.old_value, r.new_value) for r in live.top_n_deltas(rows, ["k"], "v", order, 2, path, arrival="at").collect()}
    assert got == {(0, "a", "enter", None, 10), (0, "b", "enter", None, 20), (1, "a", "update", 10, 30), (2, "b", "exit", 20, None), (2, "c", "enter", None, 5), (3, "a", "exit", 30, None), (3, "d", "enter", None, 2)}


def test_fold_resumes_after_a_stop(spark, tmp_path):
    src, path, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    watch = lambda before, after, number: seen.append((number, sorted((r.k_, r.state) for r in after.collect())))
    text = lambda df: df.withColumn("at", F.lpad(F.col("at").cast("string"), 4, "0"))
    live.checkpointed_fold(text(batches(spark, src, [("a", 1, 1, ""), ("b", 2, 2, "")])), "k", "v", "at", path, watch)
    got = live.checkpointed_fold(text(batches(spark, src, [("a", 5, 3, "")])), "k", "v", "at", path, watch)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 6, "0003"), ("b", 2, "0002")]
    assert seen == [(0, [("a", 1), ("b", 2)]), (1, [("a", 6)])]


def test_read_sessions(spark, tmp_path):
    rows = batches(spark, str(tmp_path / "in"), [("a", 1, 1, "")], [("b", 2, 2, "")], [("c", 3, 3, "")])
    s = live.ReadSession(rows, str(tmp_path / "one"))
    assert [[r.k for r in got] for _, got in s] == [["a"], ["b"], ["c"]] and s.done == "done"
    with pytest.raises(RuntimeError):
        next(iter(s))
    s = live.ReadSession(rows, str(tmp_path / "two"))
    assert next(iter(s))[0] == 0
    s.cancel()
    assert s.done == "cancelled"


def test_materialize_is_the_users_fold(spark):
    log = spark.createDataFrame([("a", i, i * i) for i in range(5)], "k string, n long, v long")
    got = fold.materialize(log, "k", ["n"], F.lit("").cast("string"), lambda s, e: F.concat(s, e.cast("string"), F.lit(",")), F.col("v")).first()
    assert got.state == "0,1,4,9,16,"


def test_create_without_messages_refuses_sub_offsets(spark):
    records = made_records(spark)
    got, _ = create.plan(ask(spark, ("f", None, None, False, None, "a", at(0), 1)), records, T0)
    assert answers(got) == ["bad-request"]


def made_records(spark):
    decided, _ = create.plan(ask(spark, ("a", "application/json", None, False, b"[1,2]", None, None, None)), spark.createDataFrame([], create.RECORD), T0)
    return decided.select(*[x.split()[0] for x in create.RECORD.split(", ")])
