"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction built from one code word per half of the coordinates; a vector belongs to all filters whose
direction exceeds a threshold, found by list decoding. Vectors that share a filter are verified by cosine in double
precision. There are CODES codes, each after a random rotation of its own and all fixed by a seed: filters of different
codes are nearly independent, so a pair needs far fewer of them than of one large code. The threshold is calibrated,
for every code size, on random pairs at the least cosine, so that a share of `recall` of them has a common filter (README
states the measured recall). A vector that exceeds no filter takes the best one of each code.

Equal vectors collapse into one class first. In a filter's bucket the pairs are never emitted: the result is a count of
links per class and a labelled forest of its components. A pair counts in its smallest common filter only. Buckets
above BLOCK members are cut into blocks; every pair of blocks is a task's work of its own, so nothing is dropped.

Defined cases: vectors that are null, of another length than most, zero, or with null or non-finite components link
with nothing; a null vec_id keeps a null component; vec_ids are the nodes: rows with one vec_id are one node, linked by
whatever any of its vectors links to, and n_links counts other vec_ids once; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidelog.llm.common import component_labels, settled, stage, table

BLOCK = 2048
CODES = 12
#: Members that a filter has on average, by the size of the code.
CROWD = 16


class CapCode:
    """`codes` product codes of two blocks of `size` random unit words: codes * size * size filter directions."""

    def __init__(self, dim: int, size: int, seed: int = 23, cosine: float = 0.95, recall: float = 0.95, codes: int = CODES):
        rng = np.random.default_rng(seed)
        self.size, self.cut, self.turns, self.words = size, dim // 2, [], []
        for _ in range(codes):
            self.turns.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            blocks = [rng.standard_normal((size, max(d, 1))) for d in (self.cut, dim - self.cut)]
            self.words.append([c / np.linalg.norm(c, axis=1, keepdims=True) for c in blocks])
        self.least = float(np.quantile(self._common(*_pairs(dim, cosine, rng)), 1 - recall))

    def _scores(self, x: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        x, (a, b) = x @ self.turns[code], self.words[code]
        return (x[:, : self.cut] @ a.T if self.cut else np.zeros((len(x), self.size))), x[:, self.cut :] @ b.T

    def _common(self, x: np.ndarray, y: np.ndarray, best: int = 48) -> np.ndarray:
        """The largest threshold at which each pair has a common filter, among the best words of each block (so never too high)."""
        out = np.full(len(x), -np.inf)
        for k in range(len(self.words)):
            halves = []
            for u, v in zip(self._scores(x, k), self._scores(y, k), strict=True):
                top = np.argsort(-(u + v), axis=1)[:, :best]
                halves.append((np.take_along_axis(u, top, 1), np.take_along_axis(v, top, 1)))
            (ux, uy), (vx, vy) = halves
            for i in range(len(x)):
                out[i] = max(out[i], np.minimum(ux[i][:, None] + vx[i], uy[i][:, None] + vy[i]).max())
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All exceeding filters of the unit vectors, as (row, filter) sorted by both."""
        rows, filters, best = [], [], []
        for k in range(len(self.words)):
            a, b = self._scores(x, k)
            r, i = np.nonzero(a >= self.least - b.max(axis=1)[:, None])  # words that any partner can lift
            hit, j = np.nonzero(b[r] >= (self.least - a[r, i])[:, None])
            rows.append(r[hit])
            filters.append((k * self.size + i[hit]) * self.size + j)
            best.append((k * self.size + a.argmax(axis=1)) * self.size + b.argmax(axis=1))
        none = np.setdiff1d(np.arange(len(x)), np.concatenate(rows))
        r, f = np.concatenate([*rows, np.repeat(none, len(best))]), np.concatenate([*filters, np.column_stack(best)[none].ravel()])
        order = np.lexsort((f, r))
        return r[order], f[order].astype(np.int32)


def _pairs(dim: int, cosine: float, rng: np.random.Generator, n: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with the given cosine."""
    x = _unit(rng.standard_normal(n * dim), dim)
    y = rng.standard_normal((n, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable by links (i, j), for every one of n members."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _decode_rows(code: CapCode, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                row, filt = code.decode(_unit(np.asarray(part.column(part.schema.get_field_index("embedding")).flatten()), dim))
                off = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(off), pa.array(filt))], names=[*part.schema.names, "filters"])

    return run


def _meet_before(lists: pa.ListArray, filt: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs have a common filter below filt. Lists are sorted."""
    off, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    flat, off = flat[off[0] : off[-1]], off - off[0]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    use = flat < filt
    n = np.bincount(row[use], minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    width = max(int(n.max(initial=0)), 1)
    m = np.repeat(-1 - np.arange(len(n))[:, None], width, axis=1)  # no filter, and no two rows' alike
    m[row[use], np.arange(int(use.sum())) - first[row[use]]] = flat[use]
    out, step = np.zeros(len(i), bool), max(1, (1 << 22) // width)
    for lo in range(0, len(i), step):
        a, b = m[i[lo : lo + step]], m[j[lo : lo + step]]
        for k in range(width):
            out[lo : lo + step] |= (a == b[:, k : k + 1]).any(axis=1)
    return out


def _bucket_links(dim: int, least: float):
    """Links of one bucket or pair of blocks: (a, root, n), and (a, b, null) for links of flagged classes."""

    def one(filt: int, bi: int, bj: int, t: pa.Table):
        t = t.combine_chunks()
        rep, weight, block, flag = (np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("cid", "weight", "block", "flag"))
        x = _unit(np.asarray(t.column("embedding").combine_chunks().flatten()), dim)
        left, right = (np.flatnonzero(block == b) for b in (bi, bj))
        found = [], []
        for lo in range(0, len(left), BLOCK):
            l_ = left[lo : lo + BLOCK]
            i, j = np.nonzero(x[l_] @ x[right].T >= least)
            i, j = l_[i], right[j]
            once = rep[i] < rep[j] if bi == bj else np.ones(len(i), bool)
            found[0].append(i[once])
            found[1].append(j[once])
        i, j = np.concatenate(found[0]), np.concatenate(found[1])
        if len(i):
            new = ~_meet_before(t.column("filters").combine_chunks(), filt, i, j)
            i, j = i[new], j[new]
        n = (np.bincount(i, weights=weight[j], minlength=len(rep)) + np.bincount(j, weights=weight[i], minlength=len(rep))).astype(np.int64)
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = order[_forest(len(rep), place[i], place[j])[place]]
        some = np.zeros(len(rep), bool)
        some[i] = some[j] = True
        odd = (flag[i] | flag[j]) > 0
        a = np.concatenate([rep[some], rep[i[odd]], rep[j[odd]]])
        b = np.concatenate([rep[root[some]], rep[j[odd]], rep[i[odd]]])
        count = pa.array(np.concatenate([n[some], np.zeros(2 * int(odd.sum()), np.int64)]), mask=np.arange(len(a)) >= int(some.sum()))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), count], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            if sum(b.num_rows for b in held) > 1:
                yield one(*key, pa.Table.from_batches(held))

        for batch in batches:  # sorted by (filter, i, j)
            keys = np.column_stack([np.asarray(batch.column(k)) for k in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if hi == lo:
                    continue
                now = tuple(int(v) for v in keys[lo])
                if key is not None and now != key:
                    yield from done()
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if key is not None:
            yield from done()

    return run


def _links(classes: DataFrame, code: CapCode, dim: int, least: float) -> DataFrame:
    """(a, b, n): b is the root of a in a bucket and n its links there, or n is null and a, b a link of a flagged class."""
    spark = classes.sparkSession
    kind = dict(classes.dtypes)["embedding"]
    schema = f"cid long, weight long, flag int, embedding {kind}"
    decoded = stage(classes.select("cid", "weight", "flag", "embedding").mapInArrow(_decode_rows(code, dim), schema + ", filters array<int>"), "decoded")
    crowd = stage(decoded.select(F.explode("filters").alias("filter")).groupBy("filter").count().where("count > 1").select("filter", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "crowd")
    rows = decoded.select("*", F.explode("filters").alias("filter")).join(crowd, "filter").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # in a bucket only the filters below it are asked for
    rows = rows.withColumn("filters", F.slice("filters", F.lit(1), F.greatest(F.array_position("filters", F.col("filter")).cast("int") - 1, F.lit(0))))
    # a member of block b meets blocks b..last as the left and 0..b as the right side
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("filter", "i", "j", "cid", "weight", "flag", "block", "filters", "embedding").repartition(n, "filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    return stage(rows.mapInArrow(_bucket_links(dim, least), "a long, b long, n long"), "links")


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", recall: float = 0.95) -> DataFrame:
    """(id, n_links, component_id) for every row."""
    kind = "array<double>" if getattr(vectors.schema["embedding"].dataType, "elementType", None) == DoubleType() else "array<float>"
    v = vectors.select(F.col(id_col).alias("id"), F.col("embedding").cast(kind).alias("embedding"))
    size = v.where("embedding is not null and size(embedding) > 0").select(F.size("embedding").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = size["d"] if size else 0
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((F.size("embedding") == dim) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("fine", fine & F.col("id").isNotNull() & F.lit(dim > 0))
    # equal vectors meet by 128 bits of hash, so that vectors themselves move once only to be classed
    key = F.struct(F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g"))
    # a vec_id's equal vectors count once; vec_ids with several vectors belong to several classes
    nodes = v.where("fine").select("id", key.alias("key"), "embedding")
    twice = stage(nodes.select("id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice")), "twice")
    repeated = not twice.isEmpty()
    if repeated:
        again = stage(nodes.join(twice, F.col("id") == F.col("twice"), "left_semi").distinct(), "again")
        multi = stage(again.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("multi")), "multi")
        nodes = nodes.join(twice, F.col("id") == F.col("twice"), "left_anti").unionByName(again).join(multi, F.col("id") == F.col("multi"), "left").withColumn("flag", F.col("multi").isNotNull().cast("int"))
    else:
        nodes = nodes.withColumn("flag", F.lit(0))
    # weight: the vec_ids of this class alone
    classes = nodes.groupBy("key").agg(F.min("id").alias("least"), F.sum(1 - F.col("flag")).cast("long").alias("weight"), F.max("flag").alias("flag"), F.first("embedding").alias("embedding"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "least", "weight", "flag", "embedding"), "classes")
    count = classes.count()
    nothing = v.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not count:
        return nothing
    code = CapCode(dim, 1 << min(11, max(4, (int(count // CROWD).bit_length() + 1) // 2)), cosine=least, recall=recall)
    links = _links(classes, code, dim, least)
    edges = links.select("a", "b")
    of = None
    if repeated:  # the classes of one vec_id are one component
        of = stage(nodes.where("flag = 1").select("id", "key").join(classes.select("cid", F.col("key").alias("e")), F.col("key") == F.col("e")).select("id", "cid"), "of")
        low = of.groupBy("id").agg(F.min("cid").alias("b"))
        edges = edges.unionByName(of.join(low, "id").select(F.col("cid").alias("a"), "b"))
    comp = component_labels(edges.select(F.explode(F.array("a", "b")).alias("node")), edges)
    # a component is named by its smallest vec_id
    comp = classes.select("cid", "least").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("component", "cid").alias("component"))
    names = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    degree = links.groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.drop("embedding").join(comp.select("cid", "component"), "cid").join(names, "component").join(degree, F.col("cid") == F.col("a"), "left")
    known = known.select(F.col("key").alias("e"), "cid", F.col("flag").alias("odd"), (F.coalesce("n", F.lit(0)) + F.col("weight")).alias("met"), "component_id")
    got = v.where("fine").select("id", key.alias("key")).join(known, F.col("key") == F.col("e")).select("id", "cid", "met", "component_id")
    if not repeated:
        return got.select("id", (F.col("met") - 1).alias("n_links"), "component_id").unionByName(nothing)
    # vec_ids of several classes: counted once each, from the links of flagged classes
    beside = stage(links.where("n is null").select("a", "b").unionByName(classes.where("flag = 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"))).distinct(), "beside")
    several = beside.join(of, F.col("b") == F.col("cid")).select("a", F.col("id").alias("other")).distinct()
    by_class = several.groupBy("a").agg(F.count("*").alias("more"))
    mine = of.join(beside, F.col("cid") == F.col("a")).select("id", "b").distinct().join(classes.select(F.col("cid").alias("b"), "weight"), "b")
    alone = mine.groupBy("id").agg(F.sum("weight").alias("alone"))
    others = of.join(several, F.col("cid") == F.col("a")).where("other <> id").select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("others"))
    total = alone.join(others, "id", "left").select(F.col("id").alias("multi_"), (F.col("alone") + F.coalesce("others", F.lit(0))).alias("all_"))
    got = got.join(by_class, F.col("cid") == F.col("a"), "left").join(total, F.col("id") == F.col("multi_"), "left")
    n_links = F.coalesce("all_", F.col("met") - 1 + F.coalesce("more", F.lit(0)))
    return got.select("id", n_links.alias("n_links"), "component_id").unionByName(nothing)


@settled
def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
