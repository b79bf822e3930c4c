"""Vectorised scanning of Arrow text columns: word bounds and hashes for whole batches without a Python loop per word.

All functions work on slices of at most CHUNK bytes (a longer single text forms a slice of its own), so memory is
bounded by the longest text. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidelog.llm import caches

CHUNK = 1 << 20
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bases of independent families of hashes; the last one is for runs of words.
_BASES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_RUNS = 2
_powers: dict[int, list[np.ndarray]] = {}
caches.owner("words", _powers.clear)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pow(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the family's odd base and of its inverse modulo 2**64."""
    if family not in _powers or len(_powers[family][0]) < n:
        got = []
        for base in (_BASES[family], pow(_BASES[family], -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[:1] = 1
            got.append(np.cumprod(p, dtype=np.uint64))
        _powers[family] = got
    return _powers[family][0][:n], _powers[family][1][:n]


def _spans(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, without a copy of the bytes where nulls are empty (as Spark has them)."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if arr.null_count and np.diff(off)[~np.asarray(arr.is_valid())].any():
        return _spans(arr.cast(pa.large_binary()).fill_null(b""))
    buf = arr.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)), off


def chunks(batch: pa.RecordBatch, col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch with the slice's text bytes and row offsets into them."""
    n = batch.num_rows
    if not n:
        return
    caches.only("words")
    data, off = _spans(batch.column(batch.schema.get_field_index(col)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_IS_WS[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial over 2**64 by prefix sums, then finalised with the length.

    Hashes of another family come from another base, so they are independent of those of the first.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _pow(max(len(data), 1), family)
    b = _LOWER[data] if lower else data
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p, out=pre[1:])
    return mix64((pre[ends] - pre[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, doc: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one row (a polynomial in the words' hashes), and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    p, q = _pow(len(h), _RUNS)
    pre = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p, out=pre[1:])
    return mix64((pre[at + k] - pre[at]) * q[at] + np.uint64((seed * 0x9E3779B97F4A7C15 + k) & 0xFFFFFFFFFFFFFFFF)), at
