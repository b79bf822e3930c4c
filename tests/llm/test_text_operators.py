"""Operators on texts against brute force, on a fixture with nulls, empty and very long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest_words import words
from pyspark.sql import functions as F

from tidelog.llm import boosted_quality, language_id, mixing, ngram_join, packing, quality_rules, registry, runs, substring_dedup
from tidelog.llm.common import crc_mod


def brute_dedup(rows, width=13, seen=()):
    first = {w: -1 for w in seen}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        if r[0] is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < r[0]:
                    gone.update(range(k, k + width))
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, rows, fixture_dir):
    got = registry.QUERIES["op1_substring_dedup"](spark, fixture_dir).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_dedup(rows)


def removed(got):
    return sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=str)


@pytest.mark.parametrize("batches,most_runs", [(1, 2), (3, 1), (7, 3)])
def test_batches_and_compaction_change_nothing(spark, rows, docs, monkeypatch, batches, most_runs):
    made, init = [], substring_dedup.WindowIndex.__init__

    def keep(self, *args):
        init(self, *args, most_runs=most_runs)
        made.append(self)

    monkeypatch.setattr(substring_dedup.WindowIndex, "__init__", keep)
    monkeypatch.setattr(runs, "BLOCK", 64)  # so that runs have many blocks
    assert removed(substring_dedup.dedup(docs, batches=batches).collect()) == brute_dedup(rows)
    assert len(made) == 1 and len(made[0].anchors.runs) <= most_runs and len(made[0].windows.runs) <= most_runs


def test_every_batch_is_decided_when_it_comes(spark, rows, docs):
    index = substring_dedup.WindowIndex(spark, parts=6, buckets=5, most_runs=2)
    known, got = [r for r in rows if r[0] is not None], []
    for lo in range(0, 160, 40):
        got += removed(index.add(docs.where(f"doc_id >= {lo} and doc_id < {lo + 40}")).collect())
        assert sorted(got, key=str) == brute_dedup([r for r in known if r[0] < lo + 40])  # no later batch is needed
    assert len(index.anchors.runs) <= 2 and len(index.windows.runs) <= 2


def test_runs_are_sorted_and_wake_single_holders(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text if i in (1, 12, 23) else " ".join(f"x{i}y{k}" for k in range(30))) for i in range(30)], "doc_id long, text string")
    index = substring_dedup.WindowIndex(spark, parts=4, buckets=3)
    marked = []
    for lo in (0, 10, 20):
        got = index.decide(docs.where(f"doc_id >= {lo} and doc_id < {lo + 10}")).collect()
        marked.append({int(d) for r in got for d in runs.unplanes(r.doc, np.int64)})
    assert marked == [set(), {12}, {23}]
    assert len(index.anchors.runs) == 1  # two runs and a compaction
    for log, dtypes in ((index.anchors, substring_dedup._ANCHOR_RUN), (index.windows, substring_dedup._WINDOW_RUN)):
        found = 0
        for run in log.runs:
            for r in run.collect():
                for block in runs.read_blocks(log.folder, r.hash.decode(), dtypes):
                    h = block[0]
                    assert (h[1:] > h[:-1]).all() and (h % np.uint64(4) == r.part).all()
                    found += len(h)
        assert found > 0 if log is index.anchors else found == 28


def test_chunks_take_nulls_slices_and_long_texts(monkeypatch):
    import pyarrow as pa

    from tidelog.llm import wordscan

    monkeypatch.setattr(wordscan, "CHUNK", 8)
    texts = ["ab", None, "", "é" * 30, None, "c d", "x"]
    loose = pa.StringArray.from_buffers(3, pa.array([0, 2, 4, 5], pa.int32()).buffers()[1], pa.py_buffer(b"abXYz"), pa.py_buffer(bytes([0b101])))  # a null over bytes
    for arr, want in ((pa.array(texts), texts), (pa.array(texts, pa.large_string()), texts), (pa.array(["no", *texts, "no"]).slice(1, 7), texts), (pa.array([None, None], pa.string()), [None] * 2), (loose, ["ab", None, "z"])):
        got = [bytes(data[a:b]).decode() for _, data, off in wordscan.chunks(pa.RecordBatch.from_arrays([arr], names=["text"]), "text") for a, b in zip(off, off[1:], strict=False)]
        assert got == [t or "" for t in want]


def test_buckets_agree_with_spark(spark):
    ids = np.array([0, 1, -1, 5, 1 << 62, -(1 << 63), (1 << 63) - 1, 123456789], np.int64)
    got = {r.i: r.part for r in substring_dedup.in_buckets(spark.createDataFrame([(int(i),) for i in ids], "i long"), "i", 97).collect()}
    assert [got[int(i)] for i in ids] == substring_dedup.bucket_of(ids, 97).tolist()


def test_ids_at_the_ends_and_in_strides(spark):
    text = " ".join(f"w{i}" for i in range(20))
    ids = [-(1 << 63), -(1 << 62) - 5, -1, 0, 1000, 2000, (1 << 63) - 1]
    got = substring_dedup.dedup(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 0 if i == ids[0] else 20 for i in ids}


def brute_components(rows, k, percent):
    sets = {}
    for r in rows:
        w = words("".join(c.lower() if c.isascii() else c for c in r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(up)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = sorted((find(ids[x]), find(ids[y])))
                up[v] = u
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("k,percent,block", [(3, 90, 4096), (5, 80, 6), (2, 50, 9)])
def test_ngram_join(spark, rows, docs, k, percent, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 60)
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # so that frequent n-grams are dealt to pairs of blocks
    monkeypatch.setattr(ngram_join, "NEAR", 3)  # so that large buckets and the second round take part
    sets, comp = brute_components(rows, k, percent)
    got = ngram_join.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])


def test_groups_of_many_members(spark, monkeypatch):
    """Documents with one prefix and size, near and far: their group is expanded, and no link is lost."""
    monkeypatch.setattr(ngram_join, "NEAR", 2)
    rng, often = random.Random(3), [f"often{i}" for i in range(31)]
    rows = [(i, " ".join([f"a{k}" for k in range(28)] + rng.sample(often, 12))) for i in range(50)]  # the rare words are the prefix
    rows += [(100 + i, " ".join([f"a{k}" for k in range(26)] + rng.sample(often, 12))) for i in range(20)]  # another group beside it
    rows += [(200 + i, " ".join([f"b{i}x{k}" for k in range(9)] + often)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = ngram_join._frequency_sketch(df, 1, 1 << 14)
    groups = collections.Counter((r.n, r.prefix_hash) for r in ngram_join.prefix_sets(df, 1, 80, sketch).collect())
    assert sorted(groups.values())[-2:] == [20, 50]
    _, comp = brute_components(rows, 1, 80)
    assert 1 < len({c for i, c in comp.items() if i < 200}) < 70
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, 1, 80).collect()} == comp


def test_packing(spark, rows, fixture_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter()
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[r[0], p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = registry.QUERIES["op2_best_fit_packing"](spark, fixture_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_plan_is_tight():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4096, 5000), np.full(999, 1500), rng.integers(1400, 2100, 3000), np.array([4096, 1, 4095])):
        hist = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        runs = packing.best_plan(hist)
        fill, given = collections.Counter(), collections.Counter()
        for length, rank, n, first, at in sorted(runs, key=lambda r: r[4]):
            given[length] += n
            for b in range(first, first + n):
                assert fill[b] == at
                fill[b] += length
        assert given == hist and max(fill.values()) <= 4096
        single = sum(v for k, v in hist.items() if k > 2048)
        assert len(fill) <= 1.03 * max(single, -(-int(lengths.sum()) // 4096)) + (len(lengths) // 2 if set(lengths.tolist()) == {1500} else 0) + (500 if lengths.min() >= 1400 else 0) + 2


def test_special_tokens_inside_words_keep_their_ids():
    tok = packing._tokenizer(packing.default_vocabulary())
    for text in ("a<|endoftext|>b <|endoftext|> c", "it's DON'T co-op 3rd", "é é é  x\u2003y\x1cz!", "Σας ΣΑΣ", "½² a1b2 --!?[]{}|~^`@\\ (x),;:y =z <b> &amp;", "ſtraſse ﬁn ÀÉ ŉİ"):
        assert next(packing.batch_ids([text.encode()], tok)) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_plain_words_go_through_the_merges_alone():
    tok = packing._tokenizer(packing.default_vocabulary())
    letters = [chr(c) for c in range(33, 0x180) if packing._PLAIN.fullmatch(chr(c))]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([*letters, " ", "\n", "e", "t", "."], n)) for n in rng.integers(0, 3000, 60)] + ["".join(letters), " ".join(letters)]
    plain = [t.encode() for t in texts]
    mixed = [" ".join(["x\U0001f600y", "naïve", *t.split(), "it's", "3rd", "straße,", "ﬁn", "Ω"]).encode() for t in texts]
    whole = lambda t: np.array(tok.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    class Counted:
        seen: list[str] = []

        def __getattr__(self, name):
            return getattr(tok, name)

        def encode(self, text, **more):
            self.seen.append(text)
            return tok.encode(text, **more)

    packing._forget()
    assert list(packing.batch_ids(plain, Counted())) == [whole(t) for t in plain]
    assert Counted.seen == []
    assert list(packing.batch_ids(mixed, Counted())) == [whole(t) for t in mixed]
    assert sorted(Counted.seen) == sorted(["x\U0001f600y", "it's", "3rd", "ﬁn", "Ω"])


def test_quality_rules(spark, rows, fixture_dir):
    got = collections.defaultdict(list)
    for r in registry.QUERIES["op3_quality_rules"](spark, fixture_dir).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
        assert not (r.kept and r.base_failed)
    for i, t, *_ in rows:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        hit = {p for k, g in enumerate(grams) if n[g] > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert want in got[i]


def test_decision_list_finds_conjunctions():
    import random

    rng, data = random.Random(1), []
    for _ in range(3000):
        f = {k: rng.random() for k in quality_rules.FEATURES}
        data.append((f, int(not (f["symbols"] > 0.6 and f["upper"] <= 0.3))))
    rules = quality_rules.learn(data)
    wrong = sum((not any(quality_rules._holds(r, f) for r in rules.rules)) != y for f, y in data)
    assert rules.rules and wrong < 60
    assert quality_rules.learn([]).rules == []


def test_mixing(spark, rows, fixture_dir):
    got = registry.QUERIES["op6_source_mixing"](spark, fixture_dir).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    target, left = {}, set(size)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    rest = sum(size.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 3 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
            left.remove(s)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(size.values())
    again = registry.QUERIES["op6_source_mixing"](spark, fixture_dir).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_meets_targets(spark):
    sized = spark.createDataFrame([(i, "abc"[i % 3 if i % 10 else 0], 1 + i * 7 % 50) for i in range(6000)], "doc_id long, source string, size long")
    got = {r["source"]: r for r in mixing.fair_queue(sized).selectExpr("source", "target", "size * times as t").groupBy("source").agg({"target": "max", "t": "sum"}).collect()}
    for r in got.values():
        assert abs(r["sum(t)"] - r["max(target)"]) <= 200


def test_language_id(spark, docs, fixture_dir):
    got = registry.QUERIES["op7_language_id"](spark, fixture_dir).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.lang_pred)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for i, t in texts.items():
        assert ("und" in by[i]) == (not any(c.isalpha() for c in t or "")), (i, t and t[:30])


def test_forward_sums_all_segmentations():
    m = language_id.PieceModel(["a", "b", "ab", "ba", "aba"], ["x", "y"], None)
    p = m.probs = np.array([[0.1, 0.2], [0.3, 0.1], [0.2, 0.3], [0.25, 0.15], [0.15, 0.25]])
    of = {k: p[int(np.searchsorted(m.keys, language_id._keys(language_id._codes([k])[0])[len(k) - 1].ravel()[0]))] for k in ("a", "b", "ab", "ba", "aba")}

    def total(w):
        return np.ones(2) if not w else sum(of[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in of)

    for w in ("a", "aba", "abab", "bbaab"):
        assert np.allclose(np.exp(m.log_likelihood([w])[0]), total(w))
    assert np.allclose(np.exp(m.log_likelihood(["az"])[0]), of["a"] * m.floor)


def test_all_pieces_and_long_runs_take_part():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language_id.default_vocabulary())
    pieces = language_id.letter_pieces(language_id.default_vocabulary())
    assert set(pieces) == {p for p in (sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())) if p.isalpha() and p == p.lower()}
    names = ["a", "b", "ab", "abababa", "bab"]
    p = np.array([[0.1, 0.2], [0.3, 0.1], [0.2, 0.3], [0.25, 0.15], [0.15, 0.25]])
    m = language_id.PieceModel(names, ["x", "y"], None)
    order = [int(np.searchsorted(m.keys, language_id._keys(language_id._codes([k])[0])[len(k) - 1].ravel()[0])) for k in names]
    m.probs = np.zeros_like(p)
    m.probs[order] = p
    assert sorted(language_id.runs_of("ab" * 900 + " ab")) == ["ab", "ab" * 900]
    for w in ("abababa", "ab" * 40, "ab" * 900 + "a"):
        total, scale = [np.ones(2)], np.zeros(2)
        for j in range(1, len(w) + 1):
            total.append(sum(q * total[j - len(k)] for k, q in zip(names, p, strict=True) if w[:j].endswith(k)))
            if j % 20 == 0:
                scale, total = scale + np.log(total[-1]), [t / total[-1] for t in total]
        assert np.allclose(m.log_likelihood([w])[0], np.log(total[-1]) + scale)
    # learning from a long run does what it does from short ones
    a, b = (language_id.PieceModel(["a", "b", "ab"], ["x"], None) for _ in range(2))
    a.learn([("ab" * 8, np.array([1.0]))], rounds=1)
    b.learn([("ab" * 400, np.array([0.02]))], rounds=1)
    assert np.allclose(a.probs, b.probs)


def test_quality_classifier(spark, rows, fixture_dir):
    got = registry.QUERIES["op10_quality_classifier"](spark, fixture_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_boosting_learns_and_traverses():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    f = boosted_quality.fit_forest(x, y)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.97
    assert boosted_quality.fit_forest(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in registry.QUERIES["op10_quality_classifier"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [(r.lang_pred, lang[r.doc_id]) for r in registry.QUERIES["op7_language_id"](spark, d).collect() if r.held_out]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert registry.QUERIES[name](spark, empty_dir).count() == 0


PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_stage_decides_by_row(spark, fixture_dir, monkeypatch):
    good, bad = "good words stand here", "bad " * 300
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ((1, good), (1, bad), (None, good), (None, bad), (2, good), (2, None))], PLAIN)
    x = {t: boosted_quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in (good, bad)}
    y = np.arange(2000) % 2
    forest = boosted_quality.fit_forest(np.array([x[good] if k else x[bad] for k in y], np.float32), y.astype(float))
    monkeypatch.setattr(boosted_quality, "fit", lambda *args: forest)
    got = stage_of("quality classifier")(spark, docs, fixture_dir).collect()
    kept = sorted((str(r.doc_id), str(r.text)) for r in got)
    nothing = boosted_quality.features(np.zeros(0, np.uint8), np.array([0, 0]))
    assert kept == sorted([("1", good), ("2", good), ("None", good)] + ([("2", "None")] if forest.score(nothing)[0] >= 0.5 else []))


def brute_near(rows, k=5, percent=80):
    """One row of every component stays: the smallest doc_id, null ids last."""
    uniq = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    sets, comp = brute_components([(i, r[1]) for i, r in enumerate(uniq)], k, percent)
    return collections.Counter(uniq[i] for i in comp if comp[i] == i)


def test_near_duplicate_stage(spark, rows, docs, fixture_dir):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    more = [(500, one, "en", "s", 1), (500, two, "en", "s", 1), (500, two, "en", "s", 1), (None, one + " x", "en", "s", 1), (None, "only here", "en", "s", 1), (None, "only here", "en", "s", 1)]
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, PLAIN))
    got = collections.Counter(plain(stage_of("n-gram Jaccard join")(spark, given, fixture_dir)))
    want = brute_near([r[:5] for r in rows] + more)
    assert collections.Counter((r[0], r[1]) for r in got.elements()) == collections.Counter((r[0], r[1]) for r in want.elements())
    assert set(got) <= set([r[:5] for r in rows] + more)


def test_substring_stage_keeps_one_row_for_each(spark, rows, docs, fixture_dir):
    text = " ".join(f"q{i}" for i in range(30))
    more = [(600, text, "en", "s", 1), (601, text + " tail", "en", "s", 1), (601, text + " tail", "en", "s", 1), (601, "other " + text, "de", "s", 2), (602, text, "en", "s", 1), (None, text, "en", "s", 1)]
    given = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, PLAIN))
    got = collections.Counter(plain(stage_of("substring dedup")(spark, given, fixture_dir)))
    every, want = [r[:5] for r in rows] + more, collections.Counter()
    first = {}
    for i, t in sorted((r[0], r[1]) for r in every if r[0] is not None):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, lang, source, n in every:
        w, gone = words(t), set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        if not gone:
            want[i, t, lang, source, n] += 1
        elif kept:
            want[i, kept, lang, source, len(kept)] += 1
    assert got == want and got[601, "tail", "en", "s", 4] == 2


def test_mixing_stage_repeats_rows_as_the_queue_takes_them(spark, docs, fixture_dir):
    given = spark.createDataFrame([(None if i % 3 else i % 7, f"w{i} " * (1 + i % 9), "en", "abc"[i % 3], i) for i in range(300)] + [(5, None, "en", None, 0)], PLAIN)
    want = collections.Counter()
    for r in mixing.fair_queue(mixing.sizes(given, "text")).collect():
        want[r.doc_id, r.text] += r.times
    got = collections.Counter(r[:2] for r in plain(stage_of("source mixing")(spark, given, fixture_dir)))
    assert got == +want and sum(got.values()) > 100


def test_pipeline_is_its_stages_and_packs_all_that_is_left(spark, fixture_dir, empty_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, fixture_dir)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(packing.default_vocabulary()), collections.Counter()
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, fixture_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and got
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_statistics_against_brute_force(rows):
    for r in rows:
        raw = (r[1] or "").encode()
        got = dict(zip(boosted_quality.NAMES, boosted_quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist(), strict=True))
        w = [x.encode() for x in words(r[1])]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n, c = collections.Counter(grams), collections.Counter(w)
        lines = [x for x in raw.split(b"\n") if x]
        m = max(len(w), 1)
        want = {
            "n_bytes": len(raw), "n_words": len(w), "mean_word": sum(map(len, w)) / m, "longest_word": max(map(len, w), default=0), "short_words": sum(len(x) <= 3 for x in w) / m,
            "distinct": len(c) / m, "top_word": max(c.values(), default=0) / m, "repeat3": sum(v for v in n.values() if v > 1) / max(len(grams), 1), "n_lines": len(lines),
            "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "line_bytes": len(raw) / max(len(lines), 1),
        }
        want |= {f"{k}_share": sum(x in v for x in raw) / max(len(raw), 1) for k, v in boosted_quality.CLASSES.items()}
        for k, v in want.items():
            assert abs(got[k] - v) <= 1e-5 * max(1, abs(v)), (r[0], k)


def test_flat_traversal_equals_walking_the_trees():
    rng = np.random.default_rng(2)
    x = rng.random((5000, 6)).astype(np.float32)
    f = boosted_quality.fit_forest(x, (x[:, 1] + x[:, 2] > 1).astype(float), trees=8)

    def walk(row):
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.cut[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x)[::97], [walk(r) for r in x[::97]])


def test_scores_of_the_query_are_those_of_the_forest(spark, rows, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    forest = boosted_quality.fit(docs, spark.read.parquet(f"{fixture_dir}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    want = collections.Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        want[r[0], round(float(forest.score(boosted_quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]), 9)] += 1
    got = collections.Counter((r.doc_id, round(r.score, 9)) for r in registry.QUERIES["op10_quality_classifier"](spark, fixture_dir).collect())
    assert got == want


def test_language_predictions_against_brute_force(spark, rows, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    model = language_id.train(docs, crc_mod("doc_id", 5) != 0, language_id.default_vocabulary())
    pieces = language_id.letter_pieces(language_id.default_vocabulary())
    place = {p: int(np.searchsorted(model.keys, language_id._keys(language_id._codes([p])[0])[len(p) - 1].ravel()[0])) for p in pieces}

    def log_sum(run):
        a, scale = [np.ones(len(model.langs))], 0.0
        for j in range(1, len(run) + 1):
            got = np.zeros(len(model.langs))
            for k in range(1, min(j, model.longest) + 1):
                piece = run[j - k : j]
                p = model.probs[place[piece]] if piece in place else (model.floor if k == 1 else 0.0)
                got = got + a[j - k] * p
            a.append(got)
        return np.log(a[-1]) + scale

    got = collections.defaultdict(list)
    for r in registry.QUERIES["op7_language_id"](spark, fixture_dir).collect():
        got[r.doc_id].append((r.lang_pred, round(r.score, 6)))
    for i, t, *_ in rows[:60] + rows[110:]:
        runs_ = language_id.runs_of(t) if t else []
        if not runs_ or len(t) > 5000:
            continue
        s = sum(log_sum(w) for w in runs_)
        assert (model.langs[int(s.argmax())], round(float(1 / np.exp(s - s.max()).sum()), 6)) in got[i]


def test_rules_decide_as_their_list_says(spark, rows, fixture_dir):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    stats = quality_rules.statistics(docs)
    rules = quality_rules.DecisionList([[("n_words", "<=", 90.0), ("mean_word", ">", 3.5)], [("stops", ">", 0.5)]])
    names = {f: F.expr(e).alias(f) for f, e in quality_rules.FEATURES.items()}
    for r in stats.select("doc_id", rules.expression().alias("rule"), *names.values()).collect():
        want = next((i for i, rule in enumerate(rules.rules, 1) if quality_rules._holds(rule, r)), None)
        assert r.rule == want


def test_taken_against_a_plain_queue(spark, rows, docs):
    sized = mixing.sizes(docs)
    got = collections.Counter((r.doc_id, r.source, r.size, r.times) for r in mixing.fair_queue(sized).collect())
    targets = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    by = collections.defaultdict(list)
    for r in sized.collect():
        by[r.source].append((int(hashlib.md5(f"17|{r.key}".encode()).hexdigest()[:13], 16), r.size, r.doc_id))
    line, budget = [], sum(x[1] for v in by.values() for x in v)
    for rank, s in enumerate(sorted(by, key=lambda s: (s is None, s or ""))):
        done, total = 0, sum(x[1] for x in by[s])
        for u, size, i in sorted(by[s], key=lambda x: x[:2]):
            done += size
            line += [((r * total + done - size / 2) / targets[s], rank, r, done, size, i, s) for r in range(3) if size]
    run, times = 0, collections.Counter()
    for _, _, r, done, size, i, s in sorted(line):
        run += size
        times[i, s, size, done] += run <= budget
    want = collections.Counter((i, s, size, n) for (i, s, size, _), n in times.items())
    for v in by.items():
        want.update((i, v[0], size, 0) for _, size, i in v[1] if not size)
    assert got == want


def test_queries_delete_only_what_they_staged(spark, fixture_dir):
    """Also beside each other: the staged tables of one query are not those of another."""
    import threading

    from tidelog.llm import common

    common.release(spark)
    got = {}

    def run(name):
        got[name] = registry.QUERIES[name](spark, fixture_dir).count()

    threads = [threading.Thread(target=run, args=(n,)) for n in ("op6_source_mixing", "op10_quality_classifier", "op3_quality_rules")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got.values())) == 1 and len(got) == 3
    assert [p.rpartition("/")[2] for p in common._staged] == ["result"] * 3
    common.release(spark)
    assert common._staged == []
