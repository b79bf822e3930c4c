"""Near-duplicate documents by the Jaccard similarity of word n-grams: a grouped prefix join.

1. Documents with equal n-gram sets collapse into classes, classes with equal prefix and size into groups. A prefix is
   the first n - ceil(t n) + 1 n-grams in one order for all: frequent ones last (frequencies of all documents, counted
   in a sketch of bounded size; they only steer the order), then by hash. Sets as similar as t share a prefix n-gram.
2. Groups meet per n-gram of their prefixes; a group drops those that no other group of possible size has (one shuffle
   of packed fingerprints). Group pairs are filtered by size and by parity bitmaps: the bits in which two bitmaps
   differ are never more than the n-grams in which the sets differ; a group of several members has one member's bitmap
   and the distance to its farthest one. An n-gram with more groups than BLOCK is dealt to blocks, and pairs of blocks.
3. The pairs left are expanded: groups of one member give a pair, others a bucket of both groups' members, which is
   filtered by their own bitmaps. Members of one group are a bucket as well.
4. Buckets never give all pairs. Round one takes, of each large bucket, each entry's pair with the bucket's first entry
   and with its nearest neighbour in size order (small buckets: all pairs). Verified links join components; round two
   takes only pairs that lie in different components. Pairs of long texts pass wider bitmaps first; then all are
   verified on the whole texts.

The result is components, not links: a link inside a component that is already joined is not looked at, because a group
of thousands of different near copies has millions of them.

Defined cases: a null or empty text has an empty set and links with nothing; fewer words than n: the whole sequence is
the one n-gram; a null doc_id links with nothing and keeps a null component; rows with one doc_id are one node;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import substring_dedup as sd
from tidelog.llm import wordscan
from tidelog.llm.common import component_labels, settled, stage, table
from tidelog.llm.runs import unplanes
from tidelog.llm.wordscan import mix64

BITS, NEAR = 1024, 16
#: Groups of one n-gram that one task may have at once.
BLOCK = 4096
LONG = 1024
BROADCAST_IDS = 2_000_000
_SETS = "doc_id long, n long, s1 long, s2 long, prefix_hash long, bitmap binary, prefix binary, wide binary"
_ENTRY = "a long, b long, token long, block int, blocks int, n int, radius int, bitmap binary"
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


def gram_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (hash, row), sorted by row and hash; ASCII letters count as lower case."""
    s, e, row = wordscan.bounds(data, off)
    h = wordscan.span_hashes(data, s, e, lower=True)
    g, at = wordscan.gram_hashes(h, row, k)
    r = row[at]
    words = np.bincount(row, minlength=len(off) - 1)
    for size in range(1, k):  # short texts: the sequence itself
        few = words[row] == size
        if few.any():
            x, i = wordscan.gram_hashes(h[few], row[few], size, seed=size)
            g, r = np.append(g, x), np.append(r, row[few][i])
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    return g[new], r[new]


def _frequency_sketch(docs: DataFrame, k: int, width: int) -> np.ndarray:
    """How many documents have an n-gram of each hash bucket; `width` numbers, whatever the input."""
    slices = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for _, data, off in wordscan.chunks(batch, "text"):
                g, _ = gram_sets(data, off, k)
                total += np.bincount((g % np.uint64(width)).astype(np.int64), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in np.split(total.astype("<u4"), slices)])], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u4").astype(np.int64)
                got[i] = got[i] + x if i in got else x
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], names=["slice", "counts"])

    rows = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(slices, "slice").mapInArrow(add, "slice int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["slice"])])


def prefix_sets(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """One row per document: set size, set and prefix fingerprints, parity bitmap, prefix n-grams."""
    mean = max(1.0, float(sketch.sum()) / len(sketch))
    level = np.floor(np.log2(np.maximum(sketch / mean, 1))).astype(np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in wordscan.chunks(batch, "text"):
                rows = len(off) - 1
                g, r = gram_sets(data, off, k)
                n = np.bincount(r, minlength=rows)
                lv = level[(g % np.uint64(len(sketch))).astype(np.int64)]
                order = np.lexsort((g, lv, r))
                g, lv = g[order], lv[order]
                first = np.concatenate([[0], np.cumsum(n)])
                need = np.where(n > 0, n - (-(-percent * n // 100)) + 1, 0)
                s1, s2, ph = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                np.add.at(s1, r, mix64(g ^ np.uint64(1)))
                np.add.at(s2, r, mix64(g ^ np.uint64(2)))
                place = np.arange(len(g)) - first[r]
                inside = place < need[r]
                np.add.at(ph, r[inside], mix64(g[inside] ^ np.uint64(3)))
                maps = []
                for lo in range(0, rows, 1024):
                    hi = min(lo + 1024, rows)
                    a, b = first[lo], first[hi]
                    bits = np.bincount((r[a:b] - lo) * BITS + (g[a:b] >> np.uint64(54)).astype(np.int64), minlength=(hi - lo) * BITS) & 1
                    maps.extend(np.packbits(bits.astype(np.uint8).reshape(-1, BITS), axis=1))
                wide: list[bytes | None] = [None] * rows
                for i in np.flatnonzero(n > LONG).tolist():  # about one bit per n-gram
                    size = int(n[i] - 1).bit_length()
                    mine = g[first[i] : first[i + 1]] >> np.uint64(64 - size)
                    wide[i] = np.packbits((np.bincount(mine.astype(np.int64), minlength=1 << size) & 1).astype(np.uint8)).tobytes()
                raw = g.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), *[pa.array(x.view(np.int64)) for x in (s1, s2, ph)], pa.array([x.tobytes() for x in maps], pa.binary()), pa.array([raw[8 * a : 8 * (a + m)] for a, m in zip(first[:-1].tolist(), need.tolist(), strict=True)], pa.binary()), pa.array(wide, pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "prefix_hash", "bitmap", "prefix", "wide"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SETS)


def _prefix_rows(parts: int, buckets: int, sketch: np.ndarray):
    """Packed (n-gram, group, size) of all prefixes, by part of the hash space.

    An n-gram that more than BLOCK documents may have goes to its groups' buckets at once, with the number of blocks that
    its groups are dealt to; so no task ever has all groups of a frequent one.
    """
    width = np.uint64(len(sketch))
    often = np.flatnonzero(sketch > BLOCK)
    dealt = np.append(-(-sketch[often] // BLOCK), 1).astype(np.uint32)
    often = np.append(often, len(sketch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 2))
            lists = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not lists:
                continue
            times = [len(x) for x in lists]
            h, d, n = np.concatenate(lists), np.repeat(ids, times), np.repeat(sizes, times).astype(np.uint32)
            cell = (h % width).astype(np.int64)
            at = np.searchsorted(often, cell)
            hot = often[at] == cell
            blocks = dealt[at]
            part = np.where(hot, parts + sd.bucket_of(d, buckets), (h % np.uint64(parts)).astype(np.int64))
            yield sd._batch(list(sd._split(part, h, d, np.where(hot, blocks, n))))

    return run


def _shared_tokens(parts: int, buckets: int, percent: int):
    """Groups per n-gram that have another group of possible size beside them (nearest in size order), by bucket of the group."""

    def one(got: list[tuple]) -> pa.RecordBatch | None:
        h, d, n = (np.concatenate(x) for x in zip(*got, strict=True))
        n = n.astype(np.int64)
        order = np.lexsort((d, n, h))
        h, d, n = h[order], d[order], n[order]
        near = (h[1:] == h[:-1]) & (100 * n[:-1] >= percent * n[1:])
        use = np.append(near, False) | np.append(False, near)
        h, d = h[use], d[use]
        return sd._batch(list(sd._split(sd.bucket_of(d, buckets), h, d, np.ones(len(h), np.uint32)))) if len(h) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:  # sorted by part
            through = []
            for p, h, d, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p >= parts:
                    through.append((p - parts, h, d, x))
                    continue
                if p != part and held:
                    if (out := one(held)) is not None:
                        yield out
                    held = []
                part = p
                held.append((unplanes(h, np.uint64), unplanes(d, np.int64), unplanes(x, np.uint32)))
            if through:
                yield sd._batch(through)
        if held and (out := one(held)) is not None:
            yield out

    return run


def _entries(left: pa.Table, right: pa.Table) -> pa.Table:
    """Groups of a bucket with every n-gram that they share, and their block of it."""
    marks = right.select(["hash", "doc", "extra"])
    got = [(unplanes(h, np.uint64), unplanes(d, np.int64), unplanes(x, np.uint32)) for h, d, x in zip(*(marks.column(i).to_pylist() for i in range(3)), strict=True)]
    token, group, blocks = (np.concatenate(v) for v in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
    gid, n, radius = (np.asarray(left.column(c).combine_chunks()).astype(np.int64) for c in ("gid", "n", "radius"))
    maps = left.column("bitmap").to_pylist()
    order = np.argsort(gid, kind="stable")
    at = np.minimum(np.searchsorted(gid[order], group), max(len(gid) - 1, 0))
    known = gid[order][at] == group if len(gid) else np.zeros(len(group), bool)
    token, group, blocks, at = token[known], group[known], blocks[known], order[at[known]]
    block = np.zeros(len(group), np.int64)
    for k in np.unique(blocks[blocks > 1]).tolist():
        m = blocks == k
        block[m] = sd.bucket_of(group[m], k)
    return _table(group, group, token, block, blocks, n[at], radius[at], [maps[i] for i in at.tolist()])


def _table(a, b, token, block, blocks, n, radius, maps: list) -> pa.Table:
    cols = [pa.array(a), pa.array(b), pa.array(token.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (block, blocks, n, radius)], pa.array(maps, pa.binary())]
    return pa.table(cols, names=_NAMES)


def _differ(maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = np.bitwise_count(maps[i[s : s + (1 << 16)]] ^ maps[j[s : s + (1 << 16)]]).sum(axis=1)
    return out


class _Bucket:
    """Entries of one task, in order of bucket and size."""

    def __init__(self, batches: list[pa.RecordBatch], key: tuple[str, ...]):
        t = pa.Table.from_batches(batches)
        col = lambda c: np.asarray(t.column(c).combine_chunks()).astype(np.int64)
        self.a, self.n, self.radius, self.block, self.blocks, self.token = (col(c) for c in ("a", "n", "radius", "block", "blocks", "token"))
        self.label = col("b") if t.column("b").null_count == 0 else self.a
        self.maps = np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(len(self.a), BITS // 64)
        keys = [col(c) for c in key]
        order = np.lexsort((self.a, self.n, *reversed(keys)))
        for name in ("a", "n", "radius", "block", "blocks", "token", "label", "maps"):
            setattr(self, name, getattr(self, name)[order])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))

    def passes(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the pairs that size and bitmaps leave, and in how many bits these differ.

        A group's bitmap is that of one member, and no other member's is farther from it than the radius.
        """
        n, both = self.n, self.n[i] + self.n[j]
        least = np.minimum(n[i], n[j])
        most = both - 2 * (-(-percent * both // (100 + percent)))
        ok = (100 * least >= percent * (both - least)) & (most >= 0)
        differ = np.full(len(i), 1 << 30)
        differ[ok] = _differ(self.maps, i[ok], j[ok])
        return ok & (differ <= most + self.radius[i] + self.radius[j]), differ


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    u = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    u = u[u[:, 0] != u[:, 1]]
    nil = pa.nulls(len(u), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.nulls(len(u), pa.int64()), nil, nil, nil, nil, pa.nulls(len(u), pa.binary())], names=_NAMES)


def _round_one(percent: int):
    """Pairs to look at first; entries of large buckets are handed on for round two (token not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        e = _Bucket(got, ("token", "block"))
        big = np.repeat(e.size > NEAR + 1, e.size) | (e.blocks > 1)
        head, place = np.repeat(e.start, e.size), np.arange(len(e.a)) - np.repeat(e.start, e.size)
        best, with_ = np.full(len(e.a), 1 << 29), np.full(len(e.a), -1)
        a, b = [], []
        for s in range(1, NEAR + 1):
            i = np.flatnonzero(place >= s)
            ok, differ = e.passes(i, i - s, percent)
            i, differ = i[ok], differ[ok]
            a.append(e.a[i[~big[i]]])
            b.append(e.a[i[~big[i]] - s])
            better = big[i] & (differ < best[i])
            best[i[better]], with_[i[better]] = differ[better], i[better] - s
        i = np.flatnonzero(with_ >= 0)
        a.append(e.a[i])
        b.append(e.a[with_[i]])
        i = np.flatnonzero(big & (place > 0))
        ok, _ = e.passes(i, head[i], percent)
        a.append(e.a[i[ok]])
        b.append(e.a[head[i[ok]]])
        yield _pair_batch(np.concatenate(a), np.concatenate(b))
        i = np.flatnonzero(big)
        for s in range(0, len(i), 20_000):
            x = i[s : s + 20_000]
            yield _table(e.a[x], e.a[x], e.token[x], e.block[x], e.blocks[x], e.n[x], e.radius[x], [m.tobytes() for m in e.maps[x]]).combine_chunks().to_batches()[0]

    return run


def _round_two(percent: int):
    """Of the large buckets: pairs that pass the filters and have different labels (column b). Rows come by token and pair of blocks i, j."""

    def pairs(e: _Bucket, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, block, sizes = e.label, e.block, e.n
        names, which, many = np.unique(c, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        # members outside the largest component against all members of possible size
        for x in np.flatnonzero(which != many.argmax()).tolist():
            p, q = np.searchsorted(sizes, -(-percent * sizes[x] // 100), "left"), np.searchsorted(sizes, 100 * sizes[x] // percent, "right")
            j = np.arange(p, q)
            j = j[(c[j] != c[x]) & ((block[j] != block[x]) if cross else True)]
            if len(j):
                ok, _ = e.passes(np.full(len(j), x), j, percent)
                yield np.full(int(ok.sum()), e.a[x]), e.a[j[ok]]

    def done(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        got = list(pairs(_Bucket(held, ("token",)), key[1] != key[2]))
        return _pair_batch(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:  # sorted by token, i, j
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(batch.column(batch.schema.get_field_index(k))).astype(np.int64) for k in ("token", "i", "j")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                now = tuple(keys[lo].tolist())
                if now != key and held:
                    if (out := done(key, held)) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held and (out := done(key, held)) is not None:
            yield out

    return run


def _fold(a: bytes, size: int) -> np.ndarray:
    """A parity bitmap at a smaller size: neighbouring bits are joined by exclusive or."""
    bits = np.unpackbits(np.frombuffer(a, np.uint8))
    while len(bits) > 8 * size:
        bits = bits[::2] ^ bits[1::2]
    return np.packbits(bits)


def sifted(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs of long texts that also pass by their wide bitmaps; these are some hundredths of the texts' size."""
    w = members.where("wide is not null").select("doc_id", "n", "wide")
    side = lambda x: w.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "na", "nb", "wa", "wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, wa, wb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if wa is None or wb is None:
                    keep.append(True)
                    continue
                size = min(len(wa), len(wb))
                differ = int(np.bitwise_count(_fold(wa, size) ^ _fold(wb, size)).sum())
                keep.append(differ <= na + nb - 2 * (-(-percent * (na + nb) // (100 + percent))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.mapInArrow(run, "a long, b long"), "sifted")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose n-gram sets are as similar as asked, from whole texts."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    some = docs.select("doc_id", "text").join(small, F.col("doc_id") == F.col("id"), "left_semi")
    both = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = []
                for col in ("ta", "tb"):
                    g, r, base = [], [], 0
                    for x, data, off in wordscan.chunks(part, col):
                        gs, rs = gram_sets(data, off, k)
                        g.append(gs)
                        r.append(rs + base)
                        base += x.num_rows
                    sets.append((np.concatenate(g), np.concatenate(r)))
                (ga, ra), (gb, rb) = sets
                g, r = np.append(ga, gb), np.append(ra, rb)
                order = np.lexsort((g, r))
                g, r = g[order], r[order]
                m = part.num_rows
                inter = np.bincount(r[1:][(g[1:] == g[:-1]) & (r[1:] == r[:-1])], minlength=m)
                union = np.bincount(r, minlength=m) - inter
                keep = (100 * inter >= percent * union) & (union > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _expanded(pairs: DataFrame, multi: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group pairs as member pairs where both groups have one member, else as buckets of both groups' members."""
    m = multi.select(F.col("gid").alias("m_"))
    side = lambda df, c: df.join(m.withColumnRenamed("m_", f"m{c}"), F.col(c) == F.col(f"m{c}"), "left")
    flagged = side(side(pairs, "a"), "b")
    plain = flagged.where("ma is null and mb is null").select("a", "b")
    mixed = flagged.where("ma is not null or mb is not null").select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("g"))
    return plain, _member_entries(mixed.join(members, F.col("g") == F.col("gid")))


def _member_entries(rows: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return rows.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), "token", zero.alias("block"), F.lit(1).alias("blocks"), F.col("n").cast("int").alias("n"), zero.alias("radius"), "bitmap")


def _groups_of(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups with the bitmap of their first member and its distance to the farthest one, and the groups of several members."""
    multi = stage(groups.where("members > 1").select("gid"), "multi")
    first = members.where("doc_id = gid").select("gid", "n", "bitmap", "prefix")
    several = members.join(multi.withColumnRenamed("gid", "g_"), F.col("gid") == F.col("g_"), "left_semi").select(F.col("gid").alias("g_"), F.col("bitmap").alias("own"))
    far = several.join(first.select("gid", "bitmap"), F.col("g_") == F.col("gid")).select("gid", "own", "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bitwise_count(x ^ y).sum(axis=1).astype(np.int32))], names=["g_", "r"])

    radius = far.mapInArrow(run, "g_ long, r int").groupBy("g_").agg(F.max("r").alias("r"))
    return stage(first.join(radius, F.col("gid") == F.col("g_"), "left").select("gid", "n", "bitmap", "prefix", F.coalesce("r", F.lit(0)).alias("radius")), "groups"), multi


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are pairs with at least `percent` % similarity."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    width = 1 << min(22, max(14, int(rows).bit_length() + 2))
    sketch = _frequency_sketch(docs, k, width)
    sets = stage(prefix_sets(docs, k, percent, sketch), "sets")
    real = sets.where("n > 0 and doc_id is not null")
    classes = stage(real.groupBy("n", "s1", "s2", "prefix_hash").agg(F.min("doc_id").alias("cid")), "classes")
    by_prefix = stage(classes.groupBy("n", "prefix_hash").agg(F.min("cid").alias("gid"), F.count("*").alias("members")), "by_prefix")
    # one row per class, with its group
    of = classes.join(by_prefix, ["n", "prefix_hash"]).select("cid", "gid", "s1", "s2", "n")
    members = stage(sets.join(of.select(F.col("cid").alias("doc_id"), "gid", "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"]).select("doc_id", "n", "gid", "bitmap", "wide", F.when(F.col("doc_id") == F.col("gid"), F.col("prefix")).alias("prefix")), "members")
    groups, multi = _groups_of(members, by_prefix)
    parts, buckets = max(n, rows // sd.DOCS_PER_PART), max(n // 2, rows // sd.DOCS_PER_BUCKET)
    prefixes = groups.select("gid", "prefix", "n").mapInArrow(_prefix_rows(parts, buckets, sketch), sd._ROWS)
    shared = stage(prefixes.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared_tokens(parts, buckets, percent), sd._ROWS), "shared")
    entries = sd.in_buckets(groups.drop("prefix"), "gid", buckets).groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(_entries, _ENTRY)
    first = lambda e: e.repartition(n, "token", "block").mapInArrow(_round_one(percent), _ENTRY)
    plain = members.select("doc_id", "n", "gid", "bitmap")
    # group pairs, then their members; members of one group meet as well
    group_one = stage(first(entries), "groups1")
    direct, mixed = _expanded(group_one.where("token is null").select("a", "b").distinct(), multi, plain)
    inner = plain.join(multi.withColumnRenamed("gid", "g_"), F.col("gid") == F.col("g_"), "left_semi").withColumn("token", F.xxhash64("gid", F.lit("group")))
    member_one = stage(first(mixed.unionByName(_member_entries(inner))), "members1")
    one = direct.unionByName(member_one.where("token is null").select("a", "b")).distinct()
    links = stage(verified(sifted(one, members, percent), docs, k, percent), "links1")
    large_groups, large_members = group_one.where("token is not null"), member_one.where("token is not null")
    if not (large_groups.isEmpty() and large_members.isEmpty()):
        comp = stage(component_labels(links.select(F.explode(F.array("a", "b")).alias("node")), links), "labels1")
        label = comp.select(F.col("node").alias("node_"), F.col("component").alias("label_"))
        named = lambda e: e.drop("b").join(label, F.col("a") == F.col("node_"), "left").withColumn("b", F.coalesce("label_", "a")).drop("node_", "label_")
        # a group whose members lie in several components has a label of its own
        whole = plain.join(multi.withColumnRenamed("gid", "g_"), F.col("gid") == F.col("g_"), "left_semi").join(label, F.col("doc_id") == F.col("node_"), "left").withColumn("c", F.coalesce("label_", "doc_id"))
        whole = stage(whole.groupBy(F.col("gid").alias("g_")).agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "labels")
        grouped = named(large_groups).join(whole, F.col("a") == F.col("g_"), "left").withColumn("b", F.when(F.col("lo") < F.col("hi"), F.xxhash64(F.lit("own"), "a")).otherwise(F.coalesce("lo", "b"))).drop("g_", "lo", "hi")
        deal = lambda e: e.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).select(*_NAMES, "i", "j")
        second = lambda e: deal(e).repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_round_two(percent), _ENTRY).select("a", "b").distinct()
        group_two = stage(second(grouped), "groups2")
        direct, mixed = _expanded(group_two, multi, plain)
        member_two = stage(second(named(large_members.unionByName(mixed))), "members2")
        links = stage(links.unionByName(verified(sifted(direct.unionByName(member_two).distinct(), members, percent), docs, k, percent)).distinct(), "links2")
    comp = component_labels(links.select(F.explode(F.array("a", "b")).alias("node")), links)
    labels = classes.join(comp.select(F.col("node").alias("cid"), "component"), "cid", "left").select("n", "s1", "s2", F.coalesce("component", "cid").alias("component_id"))
    out = sets.select("doc_id", "n", "s1", "s2").join(labels, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for one of each component: that with the smallest doc_id, null ids last.

    Nodes are rows, named by a 64-bit hash of doc_id and text, so null and repeated ids are documents of their own; rows
    equal in both are one node, of which one row stays. Rows without a word stay.
    """
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    got = stage(near_duplicates(docs.select(node.alias("doc_id"), "text"), k, percent), "components").select(F.col("doc_id").alias("node"), F.col("component_id").alias("comp"))
    # components of one row need no decision
    many = stage(got.groupBy("comp").agg(F.count("*").alias("rows_")).where("rows_ > 1").select(F.col("comp").alias("many")), "many")
    known = docs.select(node.alias("node"), "doc_id")
    of = got.distinct().join(many, F.col("comp") == F.col("many")).select("node", "comp")
    of = stage(known.withColumnRenamed("node", "node_").join(of, F.col("node_") == F.col("node")).select("node", "comp", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "node").alias("who")), "rows")
    best = of.groupBy("comp").agg(F.min("who").alias("best"))
    gone = stage(of.join(best, "comp").where(~F.col("who").eqNullSafe(F.col("best"))).select(F.col("node").alias("gone_")).distinct(), "gone")
    twice = stage(of.groupBy("who").agg(F.count("*").alias("n")).where("n > 1").select(F.col("who.node").alias("twice_")).distinct(), "twice")
    kept = docs.withColumn("node_", node).join(gone, F.col("node_") == F.col("gone_"), "left_anti")
    once = kept.join(twice, F.col("node_") == F.col("twice_"), "left_anti")
    return once.unionByName(kept.join(twice, F.col("node_") == F.col("twice_"), "left_semi").dropDuplicates(["node_", "doc_id"])).drop("node_")


@settled
def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90)
