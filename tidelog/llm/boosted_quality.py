"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat numpy arrays.

Statistics are computed over whole texts in Arrow batches (no Python loop per word). Trees are fitted on the driver
from a bounded sample of labelled rows; the fitted arrays (a few kilobytes) travel to the executors.

Defined cases: a null or empty text has all statistics 0 and still gets a score; a null doc_id is scored but never
learned from; repeated rows are scored one by one; without usable labels every score is 0.5; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import wordscan
from tidelog.llm.common import crc_mod, settled, stage, table, unit_hash

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>{}[]=_~^\\/@+",
    "point": b".,;:!?",
    "shout": b"!",
    "stop": b".",
    "comma": b",",
    "wide": bytes(range(128, 256)),
    "white": b"\t\n\x0b\x0c\r ",
}
NAMES = [
    "n_bytes", "n_words", "mean_word", "longest_word", "short_words", "distinct", "top_word", "repeat3", "n_lines", "dup_lines",
    "line_bytes", *[f"{k}_share" for k in CLASSES],
]
SAMPLE_ROWS = 20_000
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}


def _within(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct keys, largest count of a key, keys that stand more than once (all their places)."""
    if not len(key):
        z = np.zeros(n)
        return z, z.copy(), z.copy()
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], size)
    return np.bincount(r[at], minlength=n).astype(float), top, np.bincount(r[at], weights=size * (size > 1), minlength=n)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The statistics of every row of a slice, in the order of NAMES."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    s, e, row = wordscan.bounds(data, off)
    words = np.bincount(row, minlength=n).astype(float)
    w1 = np.maximum(words, 1)
    h = wordscan.span_hashes(data, s, e)
    length = (e - s).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    distinct, top, _ = _within(h, row, n)
    g, at = wordscan.gram_hashes(h, row, 3)
    grams = np.maximum(np.bincount(row[at], minlength=n), 1)
    repeated = _within(g, row[at], n)[2]
    # lines: bounded by newlines and row ends
    nl = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([off, nl + 1]))
    ls, le = cut[:-1], cut[1:]
    lrow = np.searchsorted(off, ls, "right") - 1
    stripped = le - (data[le - 1] == 10) if len(ls) else le
    full = stripped > ls
    ls, le, lrow = ls[full], stripped[full], lrow[full]
    lines = np.bincount(lrow, minlength=n).astype(float)
    dup = lines - _within(wordscan.span_hashes(data, ls, le), lrow, n)[0]
    cols = [size, words, np.bincount(row, weights=length, minlength=n) / w1, longest, np.bincount(row, weights=length <= 3, minlength=n) / w1, distinct / w1, top / w1, repeated / grams, lines, dup / np.maximum(lines, 1), size / np.maximum(lines, 1)]
    for t in _TABLES.values():
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(t[data], out=c[1:])
        cols.append((c[off[1:]] - c[off[:-1]]) / np.maximum(size, 1))
    return np.column_stack(cols).astype(np.float32)


class Forest:
    """Flat arrays of all trees: node i tests x[feature[i]] <= cut[i]; leaves point to themselves."""

    def __init__(self, feature, cut, left, right, value, roots, base, depth):
        self.feature, self.cut, self.left, self.right, self.value, self.roots, self.base, self.depth = feature, cut, left, right, value, roots, base, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(x) > 4096:
            return np.concatenate([self.score(x[i : i + 4096]) for i in range(0, len(x), 4096)])
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Logistic boosting on binned statistics; a level's histograms are three bincounts per feature."""
    empty = np.zeros(0, np.int64)
    n = len(x)
    mean = float(y.mean()) if n else 0.5
    base = float(np.log(np.clip(mean, 1e-4, 1 - 1e-4) / np.clip(1 - mean, 1e-4, 1)))
    if n < 2 * least or mean in (0.0, 1.0):
        return Forest(empty, empty, empty, empty, empty, empty, base if n else 0.0, 0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(x.shape[1])]
    b = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    f = np.full(n, base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        for a, z in ((feature, 0), (cut, 0.0), (left, i), (right, i), (value, v)):
            a.append(z)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, hs = y - p, p * (1 - p)
        root = leaf(0.0)
        roots.append(root)
        level = [(root, np.arange(n))]
        for d in range(depth + 1):
            nxt = []
            for node, idx in level:
                gs, hsum = g[idx].sum(), hs[idx].sum()
                best = (1e-6, None)
                if d < depth and len(idx) >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        k = len(e) + 1
                        hg, hh, hn = (np.bincount(b[idx, j], weights=v, minlength=k).cumsum()[:-1] for v in (g[idx], hs[idx], None))
                        gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hsum - hh + l2) - gs**2 / (hsum + l2)
                        gain[(hn < least) | (len(idx) - hn < least)] = -1
                        m = int(gain.argmax())
                        if gain[m] > best[0]:
                            best = (float(gain[m]), (j, m))
                if best[1] is None:
                    value[node] = v = rate * gs / (hsum + l2)
                    f[idx] += v
                else:
                    j, m = best[1]
                    feature[node], cut[node] = j, float(edges[j][m])
                    go = b[idx, j] <= m
                    left[node], right[node] = leaf(0.0), leaf(0.0)
                    nxt += [(left[node], idx[go]), (right[node], idx[~go])]
            level = nxt
    return Forest(*(np.array(a) for a in (feature, cut, left, right, value, roots)), base, depth)


def fit(docs: DataFrame, labels: DataFrame, train, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most about sample_rows labelled rows for which the `train` condition holds, chosen by a hash of the id.

    Statistics are taken of the chosen documents only. Their ids are broadcast: sample_rows bounds them, by the limit.
    """
    known = labels.where(F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(F.min(label).alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    chosen = known.where(unit_hash("doc_id", seed=5) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows).withColumnRenamed("doc_id", "id_")
    some = docs.select("doc_id", "text").join(F.broadcast(stage(chosen, "chosen")), F.col("doc_id") == F.col("id_"))
    got = some.select("y", "doc_id", "text").mapInArrow(_labelled_batches, "y int, doc_id long, x array<float>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * sample_rows).collect()
    x = np.array([r["x"] for r in got], np.float32).reshape(-1, len(NAMES))
    return fit_forest(x, np.array([r["y"] for r in got], float))


def _labelled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in wordscan.chunks(batch, "text"):
            x = features(data, off)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["y", "doc_id", "x"])


def _scores(batch: pa.RecordBatch, forest: Forest) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part, data, off in wordscan.chunks(batch, "text"):
        yield part, forest.score(features(data, off))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _scores(batch, forest):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`. Each row is judged by itself: no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, got in _scores(batch, forest):
                yield part.filter(pa.array(got >= least))

    return docs.mapInArrow(run, docs.schema)


@settled
def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return score(docs, forest).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
