"""Media types, message framing and body encodings."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F


def media_type(content_type: Column) -> Column:
    """Lower-cased, parameters cut off, trimmed."""
    return F.trim(F.split(F.lower(content_type), ";")[0])


def media_matches(a: Column, b: Column) -> Column:
    return media_type(a) == media_type(b)


def json_by_prefix(content_type: Column) -> Column:
    """The test that framing uses; application/json-seq passes."""
    return F.lower(content_type).startswith("application/json")


def json_exact(content_type: Column) -> Column:
    """The test that typed JSON streams use; application/json-seq fails."""
    return media_type(content_type) == "application/json"


def framed(body: Column, is_json: Column) -> Column:
    """Messages of a body: items of a top-level JSON array ([] gives none), other JSON as one, raw text as one; null for invalid JSON.

    Objects and arrays keep their text with white space compacted; numbers keep their spelling.
    """
    bad = F.try_parse_json(body).isNull()
    array = F.ltrim(body).startswith("[")
    items = F.from_json(body, "array<string>")
    typed = F.from_json(body, "array<variant>")
    quoted = F.transform(items, lambda x, i: F.when(F.schema_of_variant(F.get(typed, i)) == "STRING", F.to_json(F.get(typed, i))).otherwise(F.coalesce(x, F.lit("null"))))
    return F.when(~is_json, F.array(body)).when(bad, None).when(array, quoted).otherwise(F.array(body))


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def json_body(ordered_messages: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(ordered_messages, ","), F.lit("]"))


def bytes_body(ordered_messages: Column) -> Column:
    """Bytes of all messages, joined once (as hexadecimal text), not by a fold that copies at every step."""
    return F.unhex(F.array_join(F.transform(ordered_messages, lambda x: F.hex(x)), ""))


def batch_kind(content_type: Column) -> Column:
    """How a read delivers messages: json, text or bytes (also for no type)."""
    kind = media_type(content_type)
    return F.when(kind == "application/json", "json").when(kind.startswith("text/"), "text").otherwise("bytes")


def batch_body(content_type: Column, ordered_messages: Column) -> Column:
    """A batch's body by its kind: a JSON array, text, or bytes in hexadecimal; null (a parse error) for invalid JSON."""
    kind, text = batch_kind(content_type), F.transform(ordered_messages, lambda x: x.cast("string"))
    json = json_body(text)
    return F.when(kind == "json", F.when(F.try_parse_json(json).isNotNull(), json)).when(kind == "text", F.array_join(text, "")).otherwise(F.lower(F.hex(bytes_body(ordered_messages))))


def event_lines(text: Column) -> Column:
    """Lines of an event-stream data event: CRLF, CR and LF all end a line."""
    return F.split(text, "\r\n|\r|\n")


def data_event(content_type: Column, ordered_messages: Column) -> Column:
    """The event-stream data event of a batch: JSON items one a line, text line by line, other bytes in base64."""
    text = F.transform(ordered_messages, lambda x: x.cast("string"))
    last = F.size(text) - 1
    items = F.concat(F.lit("data:[\n"), F.array_join(F.transform(text, lambda x, i: F.concat(F.lit("data:"), x, F.when(i < last, ",").otherwise(""), F.lit("\n"))), ""), F.lit("data:]\n"))
    lines = F.concat(F.array_join(F.transform(event_lines(F.array_join(text, "")), lambda x: F.concat(F.lit("data:"), x)), "\n"), F.lit("\n"))
    raw = F.concat(F.lit("data:"), base64_plain(bytes_body(ordered_messages)), F.lit("\n"))
    kind = batch_kind(content_type)
    return F.concat(F.lit("event: data\n"), F.when(kind == "json", items).when(kind == "text", lines).otherwise(raw), F.lit("\n"))


def control_event(next_offset: Column, cursor: Column, up_to_date: Column, closed: Column) -> Column:
    """The control event that follows every data event; a closed stream has neither a cursor nor up-to-date."""
    open_ = F.concat(F.lit('","streamCursor":"'), cursor.cast("string"), F.lit('"'), F.when(up_to_date, ',"upToDate":true').otherwise(""))
    json = F.concat(F.lit('{"streamNextOffset":"'), next_offset, F.when(closed, F.lit('","streamClosed":true')).otherwise(open_), F.lit("}"))
    return F.concat(F.lit("event: control\ndata:"), json, F.lit("\n\n"))


def etag(path: Column, start: Column, end: Column, closed: Column) -> Column:
    return F.concat(F.lit('"'), base64_plain(path.cast("binary")), F.lit(":"), start, F.lit(":"), end, F.when(closed, ":c").otherwise(""), F.lit('"'))


def directory_of(stream_id: str) -> str:
    """A stream's directory: all but letters, digits, - and _ percent-encoded."""
    if not stream_id:
        raise ValueError("empty stream id")
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "".join(f"%{b:02X}" for b in c.encode()) for c in stream_id)


def stream_of(directory: str) -> str:
    return unquote(directory)


def _encoded(text: Column, keep: str) -> Column:
    """Percent-encoding of UTF-8 where letters, digits and the characters `keep` stay."""
    got = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in "-_.*":
        if c not in keep:
            got = F.replace(got, F.lit(c), F.lit(f"%{ord(c):02X}"))
    for c in "!~'()":
        if c in keep:
            got = F.replace(got, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return got


def encoded_directory(stream_id: Column) -> Column:
    """directory_of as a column; null for an empty id."""
    return F.when(stream_id != "", _encoded(stream_id, "-_"))


def decoded_directory(directory: Column) -> Column:
    return F.url_decode(F.replace(directory, F.lit("+"), F.lit("%2B")))


def encoded_path(stream_id: Column) -> Column:
    """A stream's path in a url: each segment percent-encoded."""
    return F.array_join(F.transform(F.split(stream_id, "/"), lambda x: _encoded(x, "-_.!~*'()")), "/")


def checkpoint_stream(view_id: Column) -> Column:
    """Where a view keeps its checkpoints."""
    return F.concat(F.lit("__views/"), _encoded(view_id, "-_.!~*'()"), F.lit("/checkpoint"))


def strip_prefix(path: Column, prefix: str) -> Column:
    """A path without the prefix that streams are served under (a closing slash is implied); others stay as they are."""
    full = prefix if prefix.endswith("/") else f"{prefix}/"
    return F.when(path.startswith(full), F.substring(path, len(full) + 1, 1 << 30)).otherwise(path)
