"""WARC archives with a two-level capture index.

Records are written as one gzip member each, in the order of the index: by reversed-host URL key. The index holds one
line per record, sorted by key and cut into compressed blocks; a sparse directory holds the first key and the place of
each block. A lookup binary-searches the directory, range-reads one block, binary-searches it and range-reads the
records; neighbouring ranges are read at once. Many lookups go by index file in sorted order (`read_archive`), one at a
time through `CaptureIndex`.

Files go through Arrow's file systems to the shared folder. Every task attempt writes files of its own; only what the
staged tables of entries and index files name counts, so files of lost attempts are never read.

Defined cases: a null html is an empty payload; a null url has key ''; among equal payloads of at least `least` bytes
the record with the largest page_id is the response (all of them, if that row repeats; all, if every id is null); urls are
written as they are, but for control characters and spaces, which are percent-encoded in headers; an empty table gives
empty archives; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import new_path, settled, stage, table

REVISIT_LEAST, BLOCK_LINES = 1000, 256
#: Ranges of one file with a smaller gap are read at once, up to so many bytes.
GAP, MOST = 1 << 16, 8 << 20
_ENTRY = "key string, page_id long, file string, offset long, length long"
_FILES = "file string, first_key string, last_key string, blocks long, lines long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.example.com/a?b -> com,example,www)/a?b"""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, port = rest[:cut].lower().rpartition("@")[2], ""
    if ":" in host:
        host, _, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:].partition("#")[0] or "/")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _header_value(v: str) -> str:
    return "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in v)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, size: int | None = None) -> bytes:
    """One gzip member. size: the payload's bytes, where a revisit comes without its payload."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decode_record(member: bytes) -> dict:
    """Fields of one gzip member; the digest of a response is computed anew from its payload and held against its header."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload digest differs in {h['WARC-Record-ID']}")
    page = h["WARC-Record-ID"][10:-1]
    refers = h.get("WARC-Refers-To")
    url = h.get("WARC-Target-URI")
    return {
        "page_id": int(page) if page else None, "url": url, "payload_bytes": size, "payload_digest": digest,
        "record_type": h["WARC-Type"], "refers_to": int(refers[10:-1]) if refers else None, "payload": payload,
    }


def revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """Adds payload, payload_digest and refers_to (null: response). Only ids and digests are aggregated."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    groups = p.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    groups = stage(groups.where("n > 1 and last is not null").select(F.col("payload_digest").alias("digest_"), "last"), "copies")
    j = p.join(groups, F.col("payload_digest") == F.col("digest_"), "left")
    return j.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column(1).to_pylist()), pa.string()), *batch.columns], names=["key", *batch.schema.names])


def write_archive(records: DataFrame, folder: str) -> DataFrame:
    """One file per task, in order of the key; the staged result names every record's key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows: list[list] = [[], [], [], [], []]
                for i in range(batch.num_rows):
                    key, page, url, payload, digest, refers = (batch.column(k)[i].as_py() for k in range(6))
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = encode_record(page, url, payload or b"", digest, refers, batch.column(6)[i].as_py())
                    out.write(member)
                    for col, v in zip(rows, (key, page, name, at, len(member)), strict=True):
                        col.append(v)
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    # a revisit's payload is not written, so it does not travel
    r = records.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("size"))
    keyed = r.mapInArrow(_keys, "key string, page_id long, url string, payload binary, payload_digest string, refers_to long, size long")
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(keyed.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, _ENTRY), "entries")


def build_index(entries: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Index files of sorted compressed blocks, each with its sparse directory beside it; the staged result has a row per file."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out, name, at, directory, kept, count, last = None, f"{uuid.uuid4().hex}.idx", 0, [], [], 0, None

        def flush(part):
            nonlocal out, at, count, last
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in part).encode(), 6)
            out.write(block)
            directory.append((part[0][0], at, len(block)))
            at, count, last = at + len(block), count + len(part), part[-1][0]

        for batch in batches:
            kept += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            while len(kept) >= lines:
                flush(kept[:lines])
                kept = kept[lines:]
        if kept:
            flush(kept)
        rows = []
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress("\n".join(json.dumps(x) for x in directory).encode(), 6))
            rows = [(name, directory[0][0], last, len(directory), count)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "first_key", "last_key", "blocks", "lines"])

    ordered = entries.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return stage(ordered.mapInArrow(run, _FILES), "files")


class _Files:
    """Open files of one folder, a few at a time."""

    def __init__(self, uri: str):
        self.fs, self.base = _open(uri)
        self.opened: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.opened:
            if len(self.opened) >= 16:
                self.close()
            self.opened[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.opened[name].read_at(length, offset)

    def lines(self, name: str, offset: int | None = None, length: int = 0) -> list[list]:
        if offset is None:
            with self.fs.open_input_file(f"{self.base}/{name}") as f:
                raw = f.read()
        else:
            raw = self.read(name, offset, length)
        return [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]

    def close(self) -> None:
        for f in self.opened.values():
            f.close()
        self.opened.clear()


class _Search:
    """Lookups in one index file: the directory is binary-searched, then the block."""

    def __init__(self, index: _Files, name: str):
        self.index, self.name = index, name
        self.directory = index.lines(f"{name}.dir")
        self.firsts = [x[0] for x in self.directory]
        self.at, self.block, self.keys = -1, [], []

    def _load(self, i: int) -> None:
        if i != self.at:
            self.at, self.block = i, self.index.lines(self.name, *self.directory[i][1:])
            self.keys = [x[0] for x in self.block]

    def find(self, key: str) -> Iterator[list]:
        """Entries of a key, block after block."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            self._load(i)
            lo, hi = bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)
            if hi > lo:
                yield self.block[lo:hi]
            i += 1


def _records(files: _Files, entries: list[list]) -> Iterator[dict]:
    """Records of index entries; ranges that lie near each other in a file are read at once."""
    todo = sorted((x[2], x[3], x[4]) for x in entries)
    i = 0
    while i < len(todo):
        name, start, length = todo[i]
        end, j = start + length, i + 1
        while j < len(todo) and todo[j][0] == name and todo[j][1] <= end + GAP and todo[j][1] + todo[j][2] - start <= MOST:
            end = max(end, todo[j][1] + todo[j][2])
            j += 1
        raw = files.read(name, start, end - start)
        for _, at, size in todo[i:j]:
            yield decode_record(raw[at - start : at - start + size])
        i = j


class _Bounds:
    """Which index files can hold a key. One row per index file, so as many as shuffle partitions at most."""

    def __init__(self, files: DataFrame):
        self.rows = [tuple(r) for r in files.select("first_key", "last_key", "file").orderBy("first_key", "last_key").collect()]
        self.firsts, self.lasts = [r[0] for r in self.rows], [r[1] for r in self.rows]

    def of(self, key: str) -> list[str]:
        return [r[2] for r in self.rows[bisect.bisect_left(self.lasts, key) : bisect.bisect_right(self.firsts, key)]]


class CaptureIndex:
    """Point lookups."""

    def __init__(self, files: DataFrame, index_folder: str, archive_folder: str):
        self.bounds, self.index_folder, self.archive_folder = _Bounds(files), index_folder, archive_folder

    def lookup(self, url: str) -> list[dict]:
        key, index, archives = url_key(url), _Files(self.index_folder), _Files(self.archive_folder)
        found = [r for name in self.bounds.of(key) for entries in _Search(index, name).find(key) for r in _records(archives, entries)]
        index.close()
        archives.close()
        return found


def read_archive(urls: DataFrame, files: DataFrame, index_folder: str, archive_folder: str, payload: bool = True) -> DataFrame:
    """All records of the given urls (column url): distinct keys are dealt to index files and looked up there in sorted order."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _Bounds(files)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    if not payload:
        kinds, names = kinds[:-1], names[:-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({(name, key) for key in map(url_key, batch.column(0).to_pylist()) for name in bounds.of(key)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.string()) for k in (0, 1)], names=["file", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archives, search = _Files(index_folder), _Files(archive_folder), None

        def out(entries):
            got = list(_records(archives, entries))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in zip(names, kinds, strict=True)], names=names)

        held: list = []
        for batch in batches:
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if search is None or search.name != name:
                    search = _Search(index, name)
                for entries in search.find(key):
                    held += entries
                    if len(held) >= BLOCK_LINES:
                        yield out(held)
                        held = []
        if held:
            yield out(held)
        index.close()
        archives.close()

    keys = urls.select("url").mapInArrow(deal, "file string, key string").distinct()
    schema = _READ if payload else _READ.rpartition(",")[0]
    return keys.repartition(n, "file").sortWithinPartitions("file", "key").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str, least: int = REVISIT_LEAST) -> DataFrame:
    """Write records to folder/records and their index to folder/index; returns the table of index files."""
    return build_index(write_archive(revisits(pages, least), f"{folder}/records"), f"{folder}/index")


@settled
def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    files = archive(pages, folder)
    return read_archive(pages, files, f"{folder}/index", f"{folder}/records", payload=False).drop("url")
