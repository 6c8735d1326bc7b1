"""WARC records: reading and writing, and derivatives of responses.

For every response record two records are derived, both referring to it: metadata (application/warc-fields
with the source's headers and digests) and conversion (its plain text).  Record ids are UUIDs made from the content, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"  # of pages that carry no date
BODY_BYTES = 256 << 20  # a body that inflates to more is reported as a problem, not converted
_PIECE, _HEAD = 1 << 20, 16 << 20
_SPACE_NAME = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_SKIP = re.compile(r"<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
_TAG = re.compile(r"<[/!?A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_NAME, chr(10).join((kind, *parts)))}>"


def record(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length is added.  Line ends in values become blanks, so that a value cannot add headers."""
    lines = [f"{k}: {' '.join(v.splitlines())}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _plain(data: bytes) -> Iterator[bytes]:
    """The file's bytes piece by piece, gzip members inflated; ValueError where they are damaged or end early."""
    whole = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(whole[at : at + _PIECE]) for at in range(0, len(data), _PIECE))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                piece = member.unconsumed_tail or bytes(whole[at : at + _PIECE])
                if not piece:
                    raise ValueError("the gzip data ends early")
                at += 0 if member.unconsumed_tail else len(piece)
                yield member.decompress(piece, _PIECE)
        except zlib.error as problem:
            raise ValueError(f"damaged gzip data: {problem}") from None
        at -= len(member.unused_data)
        while at < len(data) and data[at] == 0:  # padding between members
            at += 1


def read_records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of a WARC file, gzipped or not; one record is held at a time.

    ValueError where the file is malformed or damaged, after the records before that."""
    pieces, held, at = _plain(data), bytearray(), 0
    fault: list[ValueError] = []

    def more() -> bool:
        try:
            held.extend(next(pieces))
        except StopIteration:
            return False
        except ValueError as problem:
            fault.append(problem)
            return False
        return True

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and more()):
            if held[:2] == b"\r\n":
                del held[:2]
                at += 2
        if not held:
            if fault:
                raise fault[0]
            return
        end = held.find(b"\r\n\r\n")
        while end < 0 and len(held) < _HEAD and (before := len(held)) >= 0 and more():
            end = held.find(b"\r\n\r\n", max(0, before - 3))
        lines = held[:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise fault[0] if fault else ValueError(f"no WARC record at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isascii() and v.isdigit() and len(v) < 19), None)
        while size is not None and len(held) < end + 4 + size and more():
            pass
        if size is None or len(held) < end + 4 + size:
            raise fault[0] if fault else ValueError(f"record at byte {at} has no sound length")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        at += end + 4 + size


def response(url: str, html: str, key: str, date: str = DATE) -> bytes:
    """A response record of a page that was not taken from a WARC file."""
    payload = html.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return record(headers, block)


def plain_text(html: str) -> str:
    """Text of the whole page: no markup, scripts, styles or comments; a line per block, character references decoded."""
    text = _TAG.sub("", _BREAK.sub("\n", _SKIP.sub(" ", html.replace("\r", " ").replace("\n", " "))))
    lines = (" ".join(line.split()) for line in unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return "", [], block
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], body


def _unchunked(body: bytes) -> bytes:
    """The body without its chunk sizes; as it is where it has none, as some writers take them out and keep the header."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", digits):
            return b"".join(out) if out else body
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, bits: int) -> bytes:
    """What can be inflated of a body; as it is if nothing can."""
    engine, out = zlib.decompressobj(bits), b""
    try:
        out = engine.decompress(body, BODY_BYTES)
    except zlib.error:
        engine = zlib.decompressobj(bits)
        got = bytearray()
        try:
            for at in range(0, len(body), 512):
                got += engine.decompress(body[at : at + 512], BODY_BYTES)
        except zlib.error:
            pass
        return bytes(got) or body
    if engine.unconsumed_tail:
        raise ValueError(f"the body inflates to more than {BODY_BYTES} bytes")
    return out


def decoded_body(http: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content codings; ValueError for a coding that is not known."""
    of: dict[str, list[str]] = {}
    for k, v in http:
        of.setdefault(k.lower(), []).extend(x.strip().lower() for x in v.split(",") if x.strip())
    for coding in [*of.get("content-encoding", []), *of.get("transfer-encoding", [])][::-1]:
        if coding == "chunked":
            body = _unchunked(body)
        elif coding in ("gzip", "x-gzip"):
            body = _inflated(body, 31) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            body = _inflated(body, 15 if len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0 else -15)
        elif coding != "identity":
            raise ValueError(f"the content coding {coding[:40]} is not known")
    return body


def _decoded_text(body: bytes, charset: str | None) -> str:
    try:
        found = codecs.lookup(charset or "utf-8")
        return body.decode(found.name, "replace")
    except (LookupError, ValueError):  # not known, no encoding of text, or one that cannot replace what is malformed
        return body.decode("utf-8", "replace")


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[str, str, bytes]]:
    """[(type, record id, record)] of the metadata and the conversion of one response; ValueError if its body is of an
    unknown coding."""
    of = {k.lower(): v for k, v in headers}
    source, url, date = of.get("warc-record-id", ""), of.get("warc-target-uri", ""), of.get("warc-date", DATE)
    status, http, body = _http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    html = _decoded_text(decoded_body(http, body), charset and charset[1])
    text = plain_text(html).encode()
    conversion = record_id("conversion", source, digest(text))
    payload = of.get("warc-payload-digest") or digest(body)
    facts = [("source-payload-digest", payload), ("source-block-digest", of.get("warc-block-digest") or digest(block)), ("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http), *((f"source-{k.lower()}", v) for k, v in headers if k.lower() not in ("content-length", "warc-payload-digest", "warc-block-digest")), ("conversion-record-id", conversion), ("conversion-length", str(len(text)))]
    fields = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in facts).encode()
    metadata = record_id("metadata", source, digest(fields))
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    made = []
    for what, name, content, data in (("metadata", metadata, "application/warc-fields", fields), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        lines = [("WARC-Type", what), ("WARC-Record-ID", name), *common, ("WARC-Block-Digest", digest(data)), ("Content-Type", content)]
        made.append((what, name, record(lines, data)))
    return made


_SCHEMA = "source_id string, record_type string, record_id string, record binary, problem string"


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, warc): a response record per page.  Null url and html count as empty; pages may repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, html = (c.to_pylist() for c in batch.columns)
            made = [response(u or "", h or "", str(k)) for k, u, h in zip(keys, urls, html, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["i", "warc"])

    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"i {kind}, warc binary").withColumnRenamed("i", id_col)


def derivatives(files: DataFrame, warc_col: str = "warc", id_col: str = "page_id") -> DataFrame:
    """(id_col, source_id, record_type, record_id, record, problem): two records per response in each WARC file.

    Records of other types are passed over.  A null file gives no rows; of a malformed file the records before
    the fault are used, those of whole gzip members and of the whole part of a damaged one too, and a row with the reason
    in problem follows.  A response whose body has a coding that is not known, or inflates to more than BODY_BYTES, has a
    row with the reason instead of its two records.  An empty table gives no rows."""
    kind = files.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                try:
                    for headers, block in read_records(raw.as_buffer().to_pybytes()):
                        of = {k.lower(): v for k, v in headers}
                        if of.get("warc-type") == "response":
                            source = of.get("warc-record-id", "")
                            try:
                                out += [(key, source, what, name, data, None) for what, name, data in derive(headers, block)]
                            except ValueError as problem:
                                out.append((key, source, None, None, None, str(problem)))
                except ValueError as problem:
                    out.append((key, None, None, None, None, str(problem)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = (batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["i", "source_id", "record_type", "record_id", "record", "problem"])

    rows = files.select(F.col(id_col).alias("i"), F.col(warc_col).alias("w"))
    return rows.mapInArrow(work, f"i {kind}, {_SCHEMA}").withColumnRenamed("i", id_col)
