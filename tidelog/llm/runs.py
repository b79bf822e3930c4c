"""Sorted immutable runs of fingerprints: files of compressed blocks in the shared folder.

A run's part is one file of blocks, each sorted by hash, with any further columns beside it. Blocks are read one after
the other, so a merge holds one block of each run. Every task attempt writes files of its own name; only files that a
staged table names count, so what lost attempts leave behind is never read. Files go through Arrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

BLOCK = 1 << 18
_HEAD = struct.Struct("<III")


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array by significance: slowly changing high bytes then compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


class RunWriter:
    """Appends sorted blocks to a new file; the first column is the hash, stored as differences."""

    def __init__(self, folder: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.run"
        self.out, self.codec, self.entries = fs.open_output_stream(f"{base}/{self.name}", compression=None), pa.Codec("zstd", 1), 0

    def write(self, cols: tuple[np.ndarray, ...]) -> None:
        for lo in range(0, len(cols[0]), BLOCK):
            part = [c[lo : lo + BLOCK] for c in cols]
            part[0] = np.diff(part[0], prepend=part[0].dtype.type(0))
            raw = b"".join(planes(c) for c in part)
            got = self.codec.compress(raw, asbytes=True)
            self.out.write(_HEAD.pack(len(part[0]), len(raw), len(got)) + got)
            self.entries += len(part[0])

    def close(self) -> str:
        self.out.close()
        return self.name


def read_blocks(folder: str, name: str, dtypes: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks of a file, in order."""
    fs, base = pafs.FileSystem.from_uri(folder)
    codec = pa.Codec("zstd")
    with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
        while head := f.read(_HEAD.size):
            n, size, packed = _HEAD.unpack(head)
            raw = codec.decompress(f.read(packed), size, asbytes=True)
            out, at = [], 0
            for t in dtypes:
                end = at + n * np.dtype(t).itemsize
                out.append(unplanes(raw[at:end], t))
                at = end
            out[0] = np.cumsum(out[0], dtype=out[0].dtype)
            yield tuple(out)


def merged(streams: list[Iterator[tuple[np.ndarray, ...]]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted streams as one: pieces in order of the hash, every hash whole in one piece; one block of each stream is held."""
    heads = [h for s in streams if (h := (s, next(s, None)))[1] is not None]
    while heads:
        upto = min(b[0][-1] for _, b in heads)
        taken, left = [], []
        for s, b in heads:
            k = int(np.searchsorted(b[0], upto, "right"))
            if k:
                taken.append([c[:k] for c in b])
            rest = tuple(c[k:] for c in b) if k < len(b[0]) else next(s, None)
            if rest is not None:
                left.append((s, rest))
        heads = left
        cols = [np.concatenate(c) for c in zip(*taken, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        yield tuple(c[order] for c in cols)
