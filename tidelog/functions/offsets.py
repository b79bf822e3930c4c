"""Offsets: opaque strings that order a stream lexicographically. Never cast them to numbers for ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START = "-1"
ZERO = "0" * 16 + "_" + "0" * 16
# Fixed values of the cursor scheme: epoch 2024-10-09T00:00:00Z, bucket 20 s.
CURSOR_EPOCH_MS, CURSOR_BUCKET_MS, CURSOR_JITTER = 1_728_432_000_000, 20_000, 180


def default_offset(n: Column) -> Column:
    """Offset of the n-th message of a stream (from 1; 0 is the empty stream). Null beyond 16 digits."""
    text = F.concat(F.lpad(n.cast("string"), 16, "0"), F.lit("_" + "0" * 16))
    return F.when((n >= 0) & (n < F.lit(10**16)), text)


def has_default_shape(offset: Column) -> Column:
    return offset.rlike(r"^[0-9]{16}_[0-9]{16}$")


def is_valid(offset: Column) -> Column:
    """1 to 255 characters, none of , & = ? / and neither reserved word."""
    size = F.length(offset)
    return F.coalesce((size >= 1) & (size <= 255) & ~offset.isin(START, "now") & ~offset.rlike(r"[,&=?/]"), F.lit(False))


def read_start(offset: Column) -> Column:
    """Null, empty and -1 all mean the start of the stream (null)."""
    return F.when(offset.isNull() | offset.isin("", START), None).otherwise(offset)


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def live_cursor(now_ms: Column, previous: Column | None = None, draw: Column | None = None) -> Column:
    """Bucket of the clock; a client that is not behind it is moved on by at least one bucket. draw: a number in [0, 1)."""
    bucket = F.floor((now_ms - CURSOR_EPOCH_MS) / CURSOR_BUCKET_MS)
    if previous is None:
        return bucket
    jump = F.greatest(F.lit(1), F.floor((draw if draw is not None else F.lit(0.0)) * CURSOR_JITTER))
    return F.when(previous >= bucket, previous + jump).otherwise(bucket)


class DefaultOffsets:
    """The default scheme: 16 digits, an underscore, 16 zeros. A scheme gives offsets as a column and, for folds, as text."""

    def column(self, n: Column) -> Column:
        return default_offset(n)

    def text(self, n: int) -> str:
        return f"{n:016d}_{0:016d}"

    def number(self, offset: Column) -> Column:
        """How many messages lie up to an offset of this scheme."""
        return F.substring(offset, 1, 16).try_cast("long")

    def valid(self, offset: Column) -> Column:
        return is_valid(offset) & has_default_shape(offset)


class PaddedOffsets:
    """A pluggable scheme: fixed-width counters after a prefix, for strictly growing opaque offsets."""

    def __init__(self, prefix: str = "", width: int = 20):
        self.prefix, self.width = prefix, width

    def column(self, n: Column) -> Column:
        return F.when((n >= 0) & (F.length(n.cast("string")) <= self.width), F.concat(F.lit(self.prefix), F.lpad(n.cast("string"), self.width, "0")))

    def text(self, n: int) -> str:
        return f"{self.prefix}{n:0{self.width}d}"

    def number(self, offset: Column) -> Column:
        return F.substring(offset, len(self.prefix) + 1, self.width).try_cast("long")

    def valid(self, offset: Column) -> Column:
        return is_valid(offset) & offset.startswith(self.prefix) & F.substring(offset, len(self.prefix) + 1, 255).rlike(rf"^[0-9]{{{self.width}}}$")


def checked(scheme, sample: int = 3):
    """The scheme, if its first offsets are valid and grow as strings; else an error, before anything is written."""
    got = [scheme.text(n) for n in range(sample + 1)]
    if any(a >= b for a, b in zip(got, got[1:], strict=False)) or not all(1 <= len(x) <= 255 and not set(x) & set(",&=?/") and x not in (START, "now") for x in got):
        raise ValueError("offsets of a scheme must be valid and grow as strings")
    return scheme
