"""Exact removal of repeated word windows, over a log-structured fingerprint index.

A window is `width` consecutive words of one document. `WindowIndex` takes a table in batches of ascending doc_id and
decides each batch when it comes. It keeps sorted immutable runs of two kinds of window hashes (`runs`):

* anchors: the anchor of a window is the least hash among its short word runs, so equal windows have equal anchors, and
  a run of anchors is several times smaller than one of windows. An entry has the only document that holds the anchor, or
  a flag that all holders so far have been verified.
* fingerprints of verified windows (64 bits, and 32 of an independent family of hashes): all windows of all
  documents so far whose anchor stands in two documents or more.

A batch's anchors are shuffled by part of the hash space and merge-joined with the runs; what matches is verified: the
windows of these documents (and of the earlier documents that the match wakes) are fingerprinted in full, shuffled,
merge-joined with the fingerprint runs, and decided. Both steps append a run; beyond MOST_RUNS the same merge writes one
compacted run. Runs are read block by block where they lie; only the batch is shuffled.

Fingerprints are packed into blobs per part, so a shuffle moves about ten bytes per fingerprint. Before a shuffle each
task keeps only the least (for anchors: least and largest) document of a fingerprint; further documents of its own
batch are decided on the spot, so a passage that many documents share stays one entry per task.

Defined cases: a null or empty text has no words; a null doc_id is left as it is and decides nothing; repeated rows
with one doc_id do not remove each other; an empty table gives an empty result; further columns are ignored, or go
along as `keep` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.llm import wordscan
from tidelog.llm.common import drop_path, new_path, settled, stage, table
from tidelog.llm.runs import RunWriter, merged, planes, read_blocks, unplanes
from tidelog.llm.wordscan import mix64

WIDTH, ANCHOR = 13, 5
BATCHES, MOST_RUNS = 4, 2
FLUSH = 500_000
BROADCAST_IDS = 2_000_000
DOCS_PER_BUCKET, DOCS_PER_PART = 1_000, 20_000
_ROWS = "part int, hash binary, doc binary, extra binary"
_NONE = np.zeros(0, np.int64)
_ANCHOR_RUN, _WINDOW_RUN = (np.uint64, np.int64, np.uint8), (np.uint64, np.uint32)
#: Kinds of rows that a merge returns: documents of a hash, or the name of a run's file.
MARK, FILE = 0, 1


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "hash", "doc", "extra"])


def _split(part: np.ndarray, h: np.ndarray, d: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    order = np.lexsort((d, part))
    part, h, d, x = part[order], h[order], d[order], x[order]
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        if b > a:
            yield int(part[a]), planes(h[a:b]), planes(d[a:b]), planes(x[a:b])


def bucket_of(d: np.ndarray, buckets: int) -> np.ndarray:
    """pmod(xxhash64(id), buckets), as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(d.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64) % buckets


def in_buckets(df: DataFrame, id_col: str, buckets: int) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(buckets)).cast("int"))


def anchors(h: np.ndarray, row: np.ndarray, width: int, k: int) -> np.ndarray:
    """The anchor of every window, in the order of gram_hashes(h, row, width)."""
    g, at = wordscan.gram_hashes(h, row, k, seed=11)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    full = np.full(len(h), ~np.uint64(0), np.uint64)
    full[at] = g
    low, span = full, width - k + 1
    reach = 1
    while reach * 2 <= span:  # sliding minimum by doubling
        low = np.minimum(low, np.append(low[reach:], np.full(reach, ~np.uint64(0), np.uint64)))
        reach *= 2
    if reach < span:
        s = span - reach
        low = np.minimum(low, np.append(low[s:], np.full(s, ~np.uint64(0), np.uint64)))
    return low[np.flatnonzero(row[:n] == row[width - 1 :])]


class _Scan:
    """Windows of a slice: fingerprint, check, doc and place of the first word."""

    def __init__(self, data, off, ids, width, need_check=True):
        s, e, self.row = wordscan.bounds(data, off)
        self.starts, self.ends, self.width = s, e, width
        self.h = wordscan.span_hashes(data, s, e)
        self.f, self.at = wordscan.gram_hashes(self.h, self.row, width)
        self.doc = ids[self.row[self.at]]
        self.check = (wordscan.gram_hashes(wordscan.span_hashes(data, s, e, family=1), self.row, width, seed=7)[0] >> np.uint64(32)).astype(np.uint32) if need_check else None


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = part.column(0)
    return np.asarray(col.fill_null(0)).astype(np.int64), np.asarray(col.is_valid())


def _firsts(h: np.ndarray, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, x, d) and the flags of each group's first entry in it; equal triples are dropped."""
    order = np.lexsort((d, x, h))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (h[a] == h[b]) & (x[a] == x[b])
    dup = np.zeros(len(order), bool)
    dup[1:] = same[1:] & (d[a] == d[b])
    return order[~dup], ~same[~dup]


def _anchor_rows(width: int, k: int, parts: int, buckets: int):
    """Anchors of a task's documents, by part; documents between the first and the last of an anchor are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, held = [], [], 0

        def flush():
            h, d = np.concatenate(hs), np.concatenate(ds)
            order, first = _firsts(h, np.zeros(len(h), np.uint8), d)
            h, d = h[order], d[order]
            keep = first | np.append(first[1:], True)
            part = np.where(keep, (h % np.uint64(parts)).astype(np.int64), parts + bucket_of(d, buckets))
            return _batch(list(_split(part, h, d, np.zeros(len(h), np.uint32))))

        for batch in batches:
            for part, data, off in wordscan.chunks(batch, "text"):
                ids, ok = _ids(part)
                s = _Scan(data, off, ids, width, need_check=False)
                a = anchors(s.h, s.row, width, k)
                use = ok[s.row[s.at]]
                a, d = a[use], s.doc[use]
                if not len(a):
                    continue
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                hs.append(a[new])
                ds.append(d[new])
                held += len(hs[-1])
                if held >= FLUSH:
                    yield flush()
                    hs, ds, held = [], [], 0
        if hs:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch], parts: int, buckets: int, folder: str, compact: bool, decide) -> Iterator[pa.RecordBatch]:
    """Merge-join of a batch with the runs, part after part (rows come sorted by part).

    decide(h, d, x, old) returns the marks (hash, document, check) and the entries of the new run, and says how to join runs.
    Rows of a part: blobs of the batch (extra: checks) and names of run files (in hash; doc and extra are null).
    """

    def out(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        got = _batch(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *got.columns], names=["kind", "part", "hash", "doc", "extra"])

    def done(part: int, hs: list, ds: list, xs: list, files: list[str]) -> Iterator[pa.RecordBatch]:
        h, d, x = (np.concatenate([np.zeros(0, t), *(unplanes(b, t) for b in v)]) for v, t in ((hs, np.uint64), (ds, np.int64), (xs, np.uint32)))
        old = lambda: [read_blocks(folder, name, decide.dtypes) for name in files]
        (mh, md, mx), new = decide(h, d, x, old())
        if len(mh):
            yield out(MARK, list(_split(bucket_of(md, buckets), mh, md, mx)))
        if len(new[0]) or (compact and files):
            w = RunWriter(folder)
            for cols in map(decide.joined, merged([*old(), iter([new] if len(new[0]) else [])])) if compact else [new]:
                w.write(cols)
            yield out(FILE, [(part, w.close().encode(), None, None)])

    part, held = None, ([], [], [], [])
    for batch in batches:
        through = []
        for p, h, d, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if p >= parts:
                through.append((p - parts, h, d, x))
                continue
            if p != part and part is not None:
                yield from done(part, *held)
                held = ([], [], [], [])
            part = p
            if d is None:
                held[3].append(h.decode())
            else:
                for to, v in zip(held, (h, d, x), strict=False):
                    to.append(v)
        if through:
            yield out(MARK, through)
    if part is not None:
        yield from done(part, *held)


class _Anchors:
    """Anchors: marks are all documents of an anchor that two have, and its only holder in the runs."""

    dtypes = _ANCHOR_RUN

    def __call__(self, h, d, x, old):
        order, first = _firsts(h, np.zeros(len(h), np.uint8), d)
        h, d = h[order], d[order]
        start = np.flatnonzero(first)
        keys, size = h[start], np.diff(np.append(start, len(h)))
        hit, known, holder = np.zeros(len(keys), bool), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for stream in old:
            for bh, bd, bs in stream:
                lo, hi = np.searchsorted(keys, bh[0], "left"), np.searchsorted(keys, bh[-1], "right")
                at = np.searchsorted(bh, keys[lo:hi])  # inside the block: no key here is above its last hash
                same = np.flatnonzero(bh[at] == keys[lo:hi])
                hit[lo + same] = True
                known[lo + same] |= bs[at[same]] > 0
                holder[lo + same] = bd[at[same]]
        shared, woken = hit | (size > 1), hit & ~known
        use = np.repeat(shared, size)
        mh, md = np.append(h[use], keys[woken]), np.append(d[use], holder[woken])
        new = ~(hit & known)
        return (mh, md, np.zeros(len(mh), np.uint32)), (keys[new], d[start][new], shared[new].astype(np.uint8))

    @staticmethod
    def joined(cols):
        """One entry of each anchor; flagged if any run or two runs have it."""
        h, d, s = cols
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        return h[first], d[first], np.maximum(np.maximum.reduceat(s, at), (np.diff(np.append(at, len(h))) > 1).astype(np.uint8))


class _Windows:
    """Fingerprints: marks are the documents after the first, and the first as well where a run has the window."""

    dtypes = _WINDOW_RUN

    def __call__(self, h, d, x, old):
        order, first = _firsts(h, x, d)
        h, d, x = h[order], d[order], x[order]
        start = np.flatnonzero(first)
        keys, checks = h[start], x[start]
        hit = np.zeros(len(keys), bool)
        for stream in old:
            for bh, bc in stream:
                lo, hi = np.searchsorted(keys, bh[0], "left"), np.searchsorted(keys, bh[-1], "right")
                at = np.searchsorted(bh, keys[lo:hi])
                left = np.arange(lo, hi)
                while len(left):  # windows of one hash and several checks stand side by side
                    ok = at < len(bh)
                    left, at = left[ok], at[ok]
                    ok = bh[at] == keys[left]
                    left, at = left[ok], at[ok]
                    hit[left[bc[at] == checks[left]]] = True
                    at = at + 1
        mark = ~first
        mark[start[hit]] = True
        return (h[mark], d[mark], x[mark]), (keys[~hit], checks[~hit])

    @staticmethod
    def joined(cols):
        h, c = cols
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        return h[new], c[new]


class _Log:
    """Runs of one kind, and the merge that appends to them."""

    def __init__(self, spark: SparkSession, name: str, parts: int, buckets: int, most_runs: int, decide):
        self.spark, self.parts, self.buckets, self.most_runs, self.decide = spark, parts, buckets, most_runs, decide
        self.folder = new_path(spark, name)
        self.runs: list[DataFrame] = []

    def add(self, rows: DataFrame) -> DataFrame:
        """Merge-join the rows of a batch with all runs, append its run (or write one compacted run); the staged marks."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts, buckets, folder, decide, compact = self.parts, self.buckets, self.folder, self.decide, len(self.runs) >= self.most_runs
        for run in self.runs:
            rows = rows.unionByName(run)
        merge = lambda it: _merge(it, parts, buckets, folder, compact, decide)
        got = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, "kind int, " + _ROWS)
        got = stage(got, "merged")
        files = got.where(F.col("kind") == FILE).drop("kind")
        self.runs = [files] if compact else [*self.runs, files]
        return got.where(F.col("kind") == MARK).drop("kind")


class WindowIndex:
    """Log-structured index of windows under the shared folder. Batches come in ascending order of doc_id, no doc_id in two."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, anchor: int = ANCHOR, parts: int = 64, buckets: int = 64, most_runs: int = MOST_RUNS):
        self.spark, self.width, self.anchor, self.parts, self.buckets = spark, width, anchor, parts, buckets
        self.anchors = _Log(spark, "anchors", parts, buckets, most_runs, _Anchors())
        self.windows = _Log(spark, "windows", parts, buckets, most_runs, _Windows())
        self.taken: list[DataFrame] = []

    def decide(self, batch: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """The windows to remove from a batch (staged), by bucket of the document; the batch is then part of the index.

        texts: all documents so far, with the batch (else the batches themselves, one after the other).
        """
        width, k, parts, buckets = self.width, self.anchor, self.parts, self.buckets
        batch = batch.select("doc_id", "text").where("doc_id is not null")
        found = self.anchors.add(batch.mapInArrow(_anchor_rows(width, k, parts, buckets), _ROWS))
        self.taken.append(batch)
        texts = reduce(DataFrame.unionByName, self.taken) if texts is None else texts.select("doc_id", "text")
        some, _ = _of_marked(texts, found)
        windows = in_buckets(some, "doc_id", buckets).groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_window_rows(width, k, parts, buckets), _ROWS)
        return self.windows.add(windows)

    def add(self, batch: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, n_words, n_removed, kept) of a new batch, against all history and itself."""
        return cleaned(batch, self.decide(batch), self.width, self.buckets, keep)

    def drop(self) -> None:
        """Delete the run files; marks that were returned stay."""
        for log in (self.anchors, self.windows):
            drop_path(self.spark, log.folder)


def id_batches(docs: DataFrame, count: int) -> list[tuple[DataFrame, DataFrame]]:
    """Batches of about equal numbers of rows in ascending order of doc_id, each with all documents up to its end.

    Equal ids stay together; null ids go out.
    """
    at = [i / count for i in range(1, count)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", at, 1000)).first()[0] or ())) if at else []
    out, lo = [], None
    for hi in [*cuts, None]:
        texts = docs.where("doc_id is not null") if hi is None else docs.where(F.col("doc_id") < hi)
        out.append((texts if lo is None else texts.where(F.col("doc_id") >= lo), texts))
        lo = hi
    return out


def _pair(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    return mix64(h ^ mix64(d.view(np.uint64)))


class _Marks:
    """Marked (hash, check) pairs of documents."""

    def __init__(self, right: pa.Table):
        got = [(_pair(unplanes(h, np.uint64), unplanes(d, np.int64)), unplanes(x, np.uint32)) for h, d, x in zip(*(right.column(c).to_pylist() for c in ("hash", "doc", "extra")), strict=True)]
        pair, check = (np.concatenate(v) for v in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.lexsort((check, pair))
        self.pair, self.check = pair[order], check[order]

    def __len__(self):
        return len(self.pair)

    def has(self, h: np.ndarray, d: np.ndarray, check: np.ndarray | None) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if not len(self.pair):
            return out
        pair = _pair(h, d)
        lo, hi = np.searchsorted(self.pair, pair, "left"), np.searchsorted(self.pair, pair, "right")
        if check is None:
            return hi > lo
        left = np.flatnonzero(hi > lo)
        at = lo[left]
        while len(left):
            out[left[self.check[at] == check[left]]] = True
            ok = at + 1 < hi[left]
            left, at = left[ok], at[ok] + 1
        return out


def _window_rows(width: int, k: int, parts: int, buckets: int):
    """Cogroup of documents and shared anchors: fingerprints of the windows that can repeat; later holders in the bucket are marked at once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, fs, cs, ds = _Marks(right), [], [], []
        if len(shared):
            for batch in left.select(["doc_id", "text"]).combine_chunks().to_batches():
                for part, data, off in wordscan.chunks(batch, "text"):
                    ids, _ = _ids(part)
                    s = _Scan(data, off, ids, width)
                    use = shared.has(anchors(s.h, s.row, width, k), s.doc, None)
                    fs.append(s.f[use])
                    cs.append(s.check[use])
                    ds.append(s.doc[use])
        if not fs or not sum(map(len, fs)):
            return pa.Table.from_batches([_batch([])])
        f, c, d = np.concatenate(fs), np.concatenate(cs), np.concatenate(ds)
        order, first = _firsts(f, c, d)
        f, c, d = f[order], c[order], d[order]
        return pa.Table.from_batches([_batch(list(_split(np.where(first, (f % np.uint64(parts)).astype(np.int64), parts + bucket_of(d, buckets)), f, d, c)))])

    return run


def _kept(data: np.ndarray, off: np.ndarray, s: _Scan, hit: np.ndarray, always: bool) -> Iterator[tuple[int, int, bytes | None]]:
    """Per row: words, removed words, kept words joined by one space (unless always, only where words are removed)."""
    n = len(off) - 1
    cover = np.zeros(len(s.h) + 1, np.int32)
    if len(hit):
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + s.width, -1)
    gone = np.cumsum(cover[:-1]) > 0
    words, removed = np.bincount(s.row, minlength=n), np.bincount(s.row[gone], minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    raw = data.tobytes()
    for i in range(n):
        if not removed[i]:
            yield int(words[i]), 0, b" ".join(raw[off[i] : off[i + 1]].split()) if always else None
        else:
            a, b = first[i], first[i + 1]
            keep = np.flatnonzero(~gone[a:b]) + a
            yield int(words[i]), int(removed[i]), b" ".join(raw[x:y] for x, y in zip(s.starts[keep].tolist(), s.ends[keep].tolist(), strict=True))


def _result(width: int, schema: pa.Schema, text: bool):
    def rows(batch: pa.RecordBatch, marks: _Marks | None) -> Iterator[pa.RecordBatch]:
        for part, data, off in wordscan.chunks(batch, "text"):
            ids, ok = _ids(part)
            s = _Scan(data, off, ids, width, need_check=bool(marks))
            hit = s.at[ok[s.row[s.at]] & marks.has(s.f, s.doc, s.check)] if marks else _NONE
            got = list(zip(*_kept(data, off, s, hit, not text), strict=True)) or [(), (), ()]
            own = [pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *own, *part.columns[1 if text else 2 :]], schema=schema)

    return rows


def cleaned(docs: DataFrame, marks: DataFrame, width: int, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) and the columns `keep` (under a leading _) of every row, from the windows to remove.

    With `text` among `keep`, kept is null where nothing is removed.
    """
    text, more = "text" in keep, [c for c in keep if c != "text"]
    docs = docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in more])
    some, rest = _of_marked(docs, marks)
    extra = [F.col("text").alias("_text")] * text + [F.col(f"_{c}") for c in more]
    ddl = docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept"), *extra).schema
    schema = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(ddl)])
    rows, names = _result(width, schema, text), docs.columns

    def plain(batches):
        for batch in batches:
            yield from rows(batch, None)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        seen = _Marks(right)
        return pa.Table.from_batches([x for b in left.select(names).combine_chunks().to_batches() for x in rows(b, seen)], schema=schema)

    return rest.mapInArrow(plain, ddl).unionByName(in_buckets(some, "doc_id", buckets).groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(cut, ddl))


def dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, batches: int = BATCHES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row, and the columns `keep` under a leading _.

    docs go through `WindowIndex` in batches of ascending doc_id; their number changes no result.
    """
    spark = docs.sparkSession
    n, rows = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    # no more parts and buckets than there is work for: a blob goes from each bucket to each part
    index = WindowIndex(spark, width, anchor, max(n, rows // DOCS_PER_PART), max(n // 2, rows // DOCS_PER_BUCKET))
    marks = reduce(DataFrame.unionByName, [index.decide(*batch) for batch in id_batches(docs, batches)])
    index.drop()
    return cleaned(docs, marks, width, index.buckets, keep)


def _of_marked(docs: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with marks, and the others. The ids are broadcast only up to BROADCAST_IDS of them."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(unplanes(x, np.int64)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(got)) if got else _NONE)], names=["id_"])

    known = stage(marks.select("doc").mapInArrow(ids, "id_ long").distinct(), "ids")
    small = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    return docs.join(small, docs["doc_id"] == small["id_"], "left_semi"), docs.join(small, docs["doc_id"] == small["id_"], "left_anti")


@settled
def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
