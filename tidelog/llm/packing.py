"""Best-fit packing of token sequences by linear grouping.

Texts become token ids in Arrow batches; documents longer than the capacity are cut. Lengths are integers up to the
capacity, so the whole instance is a histogram of at most `capacity` entries: the plan is made on the driver from that
histogram, whatever the number of documents, and says for each length which ranks go to which sequences at which place.

Plan: lengths above `large` are put into groups of equal cardinality and rounded up to the longest of the group; the
few sizes left are packed by configurations (column generation with a knapsack for pricing, rounded down); the actual
lengths take the slots; what is left is placed by best fit, longest first.

Defined cases: a null or empty text is the closing token alone; repeated rows are packed one by one; a null doc_id is
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import caches
from tidelog.llm.common import settled, stage, table

CAPACITY = 4096
CACHE_WORDS = 250_000
ROWS_PER_SALT = 50_000
_cache: dict[bytes, bytes] = {}
_old: dict[bytes, bytes] = {}
_loaded: dict[str, object] = {}
_pieces: dict[str, bytes] = {}
_old_pieces: dict[str, bytes] = {}
_LETTERS, _POINTS = "A-Za-zÀ-ÖØ-öø-įı-ž", r"!-&(-/:;=?-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_POINTS}]+")
_PIECE = re.compile(f"[{_LETTERS}]+|[{_POINTS}]+|\n")
_LAST = ord("ž") + 1
_ODD = np.array([c != 10 and not _PLAIN.fullmatch(chr(c)) for c in range(_LAST + 1)])  # the last entry stands for all above
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _forget() -> None:
    for kept in (_loaded, _cache, _old, _pieces, _old_pieces):
        kept.clear()


caches.owner("packing", _forget)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one text at a time: a pool of threads would only wait
        from tokenizers import Tokenizer

        _forget()
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def _ends(tok) -> np.ndarray:
    """Which ids end a pre-token."""
    if "ends" not in _loaded:
        vocab = tok.get_vocab(with_added_tokens=True)
        flags = np.zeros(max(vocab.values()) + 1, bool)
        flags[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        _loaded["ends"] = flags
    return _loaded["ends"]


def _byte_level() -> str:
    """The character that stands for each byte in a byte-level vocabulary; a space stays one, to part the pieces."""
    shown, others = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return "".join([chr(b if b in shown else next(others)) for b in range(256)]).replace("Ġ", " ")


_BYTE_LEVEL = _byte_level()


def _bare(tok):
    """The tokenizer's own merges alone, for text that is normal, cut at its spaces and spelled by bytes already."""
    if "bare" not in _loaded:
        from tokenizers import Tokenizer, pre_tokenizers

        _loaded["bare"] = Tokenizer(tok.model)
        _loaded["bare"].pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return _loaded["bare"]


def _piece_ids(tok, pieces: list[str]) -> np.ndarray:
    """Ids of lower-case pieces, all in one."""
    spelled = codecs.charmap_decode(" ".join(pieces).encode(), "strict", _BYTE_LEVEL)[0]
    return np.array(_bare(tok).encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")


def _fill_cache(tok, new: list[bytes]) -> None:
    """Ids of words not seen yet.

    Words of Latin letters and plain punctuation are cut into the tokenizer's pre-tokens here (for them, NFC and lower
    case leave no choice), because far fewer of these are new; new ones go through its merges in one call. All other
    words go through the whole tokenizer one by one.
    """
    text = b"\n".join(new).decode()
    points = np.frombuffer(text.encode("utf-16-le"), "<u2")  # surrogates are odd too
    odd = np.flatnonzero(_ODD[np.minimum(points, _LAST)])
    if len(odd):
        words, apart = text.split("\n"), set(np.searchsorted(np.flatnonzero(points == 10), odd).tolist())
        for i in apart:
            _cache[new[i]] = np.array(tok.encode(words[i], add_special_tokens=False).ids, "<u4").tobytes()
        new = [w for i, w in enumerate(new) if i not in apart]
        text = "\n".join([s for i, s in enumerate(words) if i not in apart])
    if not new:
        return
    cut = _PIECE.findall(text.lower())
    unknown = _recall(set(cut), _pieces, _old_pieces)
    if unknown:
        unknown = list(unknown)
        ids = _piece_ids(tok, unknown)
        last = np.flatnonzero(_ends(tok)[ids])
        if len(last) == len(unknown):
            raw = ids.tobytes()
            at = [0, *(4 * (last + 1)).tolist()]
            _pieces.update((p, raw[x:y]) for p, x, y in zip(unknown, at, at[1:], strict=False))
        else:
            _pieces.update((p, np.array(tok.encode(p, add_special_tokens=False).ids, "<u4").tobytes()) for p in unknown)
    # no id has a high byte, so four of them mark the ends of words
    _pieces["\n"] = b"\xff\xff\xff\xff"
    _cache.update(zip(new, b"".join(map(_pieces.__getitem__, cut)).split(b"\xff\xff\xff\xff"), strict=True))


def _recall(wanted: set, young: dict, old: dict) -> set:
    """What neither generation of a cache has. A full young generation becomes the old one; what is used is kept."""
    if len(young) > CACHE_WORDS:
        old.clear()
        old.update(young)
        young.clear()
    wanted = wanted.difference(young)
    unknown = wanted.difference(old)  # an intersection would walk through all of old
    known = wanted - unknown
    young.update(zip(known, map(old.__getitem__, known), strict=True))
    unknown.discard("\n")
    return unknown


def batch_ids(texts: list[bytes], tok) -> Iterator[bytes]:
    """Ids of texts as little-endian 32-bit numbers. The tokenizer drops white space, so words are independent.

    New words of all texts are looked up together, in caches of two bounded generations.
    """
    split = [t.split() for t in texts]
    new = _recall(set().union(*split), _cache, _old)
    if new:
        _fill_cache(tok, list(new))
    get = _cache.__getitem__
    for words in split:
        yield b"".join(map(get, words))


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing: int = 1) -> DataFrame:
    end = int(closing).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("packing")
        tok = _tokenizer(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids = (raw for i in range(0, batch.num_rows, 512) for raw in batch_ids(batch.column(1).slice(i, 512).cast(pa.binary()).fill_null(b"").to_pylist(), tok))
            for doc, raw in zip(batch.column(0).to_pylist(), ids, strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for col, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def _patterns(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (count per size, how many sequences) by column generation; the rest of each demand stays open."""
    m = len(sizes)
    size, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([max(1, capacity // s) for s in sizes]).astype(float)
    for _ in range(rounds):
        inv = np.linalg.inv(basis)
        dual = np.ones(m) @ inv
        # knapsack over the duals in layers: layer k has the best value of exactly k pieces within each room
        layer, picks = np.zeros(capacity + 1), []
        top, col = (0.0, None), np.zeros(m)
        for _ in range(capacity // int(size.min())):
            nxt, pick = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
            for k in np.flatnonzero(dual > 1e-12).tolist():
                v = layer[: capacity + 1 - sizes[k]] + dual[k]
                better = v > nxt[sizes[k] :]
                nxt[sizes[k] :][better] = v[better]
                pick[sizes[k] :][better] = k
            picks.append(pick)
            layer = nxt
            if layer[capacity] > top[0] + 1e-12:
                top = (float(layer[capacity]), len(picks))
        if top[0] <= 1 + 1e-6:
            break
        room = capacity
        for pick in reversed(picks[: top[1]]):
            k = int(pick[room])
            col[k] += 1
            room -= sizes[k]
        x, step = inv @ d, inv @ col
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        basis[:, int(ratio.argmin())] = col
    x = np.linalg.inv(basis) @ d
    return [(tuple(int(v) for v in basis[:, j]), int(np.floor(x[j] + 1e-9))) for j in range(m) if x[j] >= 1]


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY, large: int | None = None, groups: int = 64) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset): ranks r of a length go to consecutive sequences."""
    large = capacity // 8 if large is None else large
    left = {k: v for k, v in hist.items() if v}
    used: dict[int, int] = defaultdict(int)  # ranks given out per length
    runs: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, number)
    next_bin = 0

    def place(length: int, n: int, first: int, room: int) -> None:
        runs.append((length, used[length], n, first, capacity - room))
        used[length] += n
        left[length] -= n
        if room > length:
            open_[room - length].append((first, n))

    n = left.get(capacity, 0)
    if n:
        place(capacity, n, 0, capacity)
        next_bin = n
    big = sorted((k for k, v in left.items() if v and k > large), reverse=True)
    total = sum(left[k] for k in big)
    if total:
        # groups of equal cardinality, longest first; a length may lie in two groups
        share, queues, fill = max(1, -(-total // groups)), [[]], 0
        for k in big:
            n = left[k]
            while n:
                if fill == share:
                    queues.append([])
                    fill = 0
                take = min(n, share - fill)
                queues[-1].append([k, take])
                fill, n = fill + take, n - take
        sizes = [q[0][0] for q in queues]
        uniq = sorted(set(sizes), reverse=True)
        merged = [[x for s, q in zip(sizes, queues, strict=True) if s == u for x in q] for u in uniq]
        for pattern, times in _patterns(uniq, [sum(x[1] for x in q) for q in merged], capacity):
            blocks = [(next_bin, times, capacity)]
            next_bin += times
            for g, count in enumerate(pattern):
                for _ in range(count):
                    after = []
                    for first, n, room in blocks:  # actual documents take the slots of their group
                        while n and merged[g]:
                            k, have = merged[g][0]
                            t = min(n, have)
                            runs.append((k, used[k], t, first, capacity - room))
                            used[k] += t
                            left[k] -= t
                            merged[g][0][1] -= t
                            if not merged[g][0][1]:
                                merged[g].pop(0)
                            after.append((first, t, room - k))
                            first, n = first + t, n - t
                        if n:
                            after.append((first, n, room))
                    blocks = after
            for first, n, room in blocks:
                if room:
                    open_[room].append((first, n))
    # best fit, longest first, on runs of sequences with equal room
    rooms = np.zeros(capacity + 1, np.int64)
    for r, q in open_.items():
        rooms[r] = sum(n for _, n in q)
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        while left[length]:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = int(fit[0]) + length
                first, n = open_[room].pop()
                t = min(n, left[length])
                rooms[room] -= n
                if n > t:
                    open_[room].append((first + t, n - t))
                    rooms[room] += n - t
                place(length, t, first, room)
            else:
                per = capacity // length
                t = max(1, left[length] // per)
                first, room = next_bin, capacity
                next_bin += t
                place(length, t, first, room)
                room -= length
            if capacity > length and room - (length if len(fit) else 0) > 0:
                rooms[room - (length if len(fit) else 0)] += t
    return runs


def best_plan(hist: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = (24, 64)) -> list[tuple[int, int, int, int, int]]:
    """The plan with fewest sequences over some numbers of groups: few leave slack for small lengths, many cut the rounding."""
    plans = [plan_packing(hist, capacity, groups=g) for g in groups]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset. Ranks within a length come from salted counts; a length has a salt per ROWS_PER_SALT rows, so a hot one spreads over tasks."""
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = F.broadcast(spark.createDataFrame([(k, 1 + v // ROWS_PER_SALT) for k, v in hist.items()], "length long, salts long"))
    own = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(own, F.col("salts"))).drop("salts")
    cells = stage(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    runs = best_plan(hist, capacity)
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = cells.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(ahead_of, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    # the runs of a length as sorted arrays; a rank finds its run by binary search in a batch
    by_length: dict[int, tuple] = {}
    for k in hist:
        mine = np.array(sorted(r[1:] for r in runs if r[0] == k) if len(runs) < 2000 else [], np.int64)
        by_length[k] = mine
    if len(runs) >= 2000:
        grouped: dict[int, list] = defaultdict(list)
        for r in runs:
            grouped[r[0]].append(r[1:])
        by_length = {k: np.array(sorted(v), np.int64) for k, v in grouped.items()}
    lookup = spark.sparkContext.broadcast(by_length)  # at most a few runs per length and room, whatever the number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = lookup.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                m = length == k
                t = table_[int(k)]
                i = np.searchsorted(t[:, 0], rank[m], "right") - 1
                seq[m], at[m] = t[i, 2] + rank[m] - t[i, 0], t[i, 3]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(at)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(run, _SCHEMA + ", sequence_id long, offset long")


@settled
def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(stage(tokenized_pieces(table(spark, sf_dir, "documents"), default_vocabulary()), "pieces"))
