"""Derivatives of WARC responses: metadata and plain-text conversion records.

Each response gives one ``metadata`` record (JSON: the source record, its HTTP
status and headers, the title and the links of the page) and one ``conversion``
record (the text of the page). Both refer to the response by its record id and
carry the digests of their own block and of the source's payload. Records are
rows; :func:`serialised` gives their bytes in WARC/1.0 format, and
:func:`parse_records` reads such bytes back.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import require_columns

#: Column types of records, of responses and derived ones alike.
RECORDS = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_headers map<string,string>, block binary"
_NAMES = ["record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "source_headers", "block"]
_TYPES = [pa.string()] * 8 + [pa.map_(pa.string(), pa.string()), pa.binary()]

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the published name space of URLs
_DROPPED = re.compile(r"(?i)<!--|<(script|style|noscript|template|svg)\b|<!|<\?")
_CLOSED = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "noscript", "template", "svg")}
_BLOCKS = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>")
_TAGS = re.compile(r"</?[A-Za-z][^>]*>")
_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title\s*>")
_ANCHOR = re.compile(r"(?i)<a\s")
_HREF = re.compile(r"(?i)\bhref")
_TARGET = re.compile(r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC files write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _visible(page: str) -> str:
    """A page with a space for each comment, declaration and element whose text isn't shown; one pass, whatever is left open.

    Comments and elements left open reach to the end, declarations left open stay.
    """
    out, at, last = [], 0, page.rfind(">")
    while m := _DROPPED.search(page, at):
        if m[0] == "<!--":
            end = page.find("-->", m.end()) + 3
            end = end if end > 2 else len(page)
        elif m[1]:
            close = _CLOSED[m[1].lower()].search(page, m.end())
            end = close.end() if close else len(page)
        elif m.end() <= last:
            end = page.find(">", m.end()) + 1
        else:  # no tag ends behind this place
            out.append(page[at : m.end()])
            at = m.end()
            continue
        out += [page[at : m.start()], " "]
        at = end
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The text of a page: blocks on lines of their own, white space collapsed, entities resolved, empty lines left out."""
    text = _visible(page)
    cut = text.rfind(">") + 1  # behind it no tag ends, and none is looked for
    text = _TAGS.sub("", _BLOCKS.sub("\n", text[:cut])) + text[cut:]
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def page_links(page: str) -> list[str]:
    """Link targets in order, each once. What stands up to the end of a tag is searched once, for all anchors that begin in it."""
    text, at, found = _visible(page), 0, []
    while m := _ANCHOR.search(text, at):
        end = text.find(">", m.end())
        end = len(text) if end < 0 else end
        at = end
        for h in _HREF.finditer(text, m.end(), end):
            if target := _TARGET.match(text, h.start()):
                found.append(target[1] or target[2] or target[3])
                at = target.end()
                break
    return list(dict.fromkeys(entities.unescape(t or "") for t in found))


def split_response(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and payload of an HTTP message; a block without a header end is all payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return "", {}, block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip()] = value.strip()
    return first, headers, payload


def response_block(payload: str, content_type: str = "text/html; charset=utf-8") -> bytes:
    data = payload.encode("utf-8", "replace")
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(data)}\r\n\r\n".encode() + data


def _derive(record_id: str, uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    block = block or b""
    status, headers, payload = split_response(block)
    page = payload.decode("utf-8", "replace")
    title = _TITLE.search(page)
    about = {
        "source": record_id,
        "status": status,
        "headers": headers,
        "title": " ".join(entities.unescape(title[1]).split()) if title else None,
        "links": page_links(page),
    }
    out = []
    for kind, content_type, body in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()),
        ("conversion", "text/plain", plain_text(page).encode("utf-8", "replace")),
    ):
        out.append(
            {
                "record_id": f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {record_id}')}>",
                "record_type": kind,
                "refers_to": record_id,
                "target_uri": uri,
                "date": date,
                "content_type": content_type,
                "block_digest": digest(body),
                "payload_digest": digest(payload),
                "source_headers": list(headers.items()),
                "block": body,
            }
        )
    return out


def derivatives(responses: DataFrame, record_id: str = "record_id", uri: str = "target_uri", date: str = "date", block: str = "block") -> DataFrame:
    """Two rows of :data:`RECORDS` for each response: ``metadata``, then ``conversion``.

    Records that aren't of type ``response`` (if there is a ``record_type``) and
    rows without a record id, to which nothing could refer, give none. A null
    or empty block gives records of an empty page. Record ids follow from the
    source's, so a task that runs again gives the same; repeated rows give
    repeated records. Other columns are ignored; an empty table gives an empty
    result.
    """
    require_columns(responses, record_id, uri, date, block)
    rows = responses.where(F.col(record_id).isNotNull())
    if "record_type" in responses.columns:
        rows = rows.where(F.col("record_type") == "response")
    rows = rows.select(F.col(record_id).cast("string"), F.col(uri).cast("string"), F.col(date).cast("string"), F.col(block).cast("binary"))
    kind = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                made = [r for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in _derive(*row)]
                yield pa.RecordBatch.from_pylist(made, kind)

    return rows.mapInArrow(run, RECORDS)


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records; the record id follows from the page's id and URL, and is null where the id is null."""
    require_columns(pages, key, url, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                made = []
                for page_id, address, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = None if page_id is None else f"<urn:uuid:{uuid.uuid5(_SPACE, f'response {page_id} {address}')}>"
                    made.append({"page_id": page_id, "record_id": own, "target_uri": address, "date": date, "block": response_block(page or "")})
                yield pa.RecordBatch.from_pylist(made, schema=_page_schema(part.schema.field(0).type))

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`").cast("string"), F.col(f"`{html}`").cast("string"))
    return rows.mapInArrow(run, f"page_id {kind}, record_id string, target_uri string, date string, block binary")


def _page_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("page_id", key), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("block", pa.binary())])


def serialised(records: DataFrame) -> DataFrame:
    """``record_id, warc``: each record as the bytes of a WARC/1.0 file. A null field is left out, a null block is empty."""

    def field(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")

    block = F.coalesce(F.col("block"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.col("record_id")),
        field("WARC-Refers-To", F.col("refers_to")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Date", F.col("date")),
        field("WARC-Block-Digest", F.col("block_digest")),
        field("WARC-Payload-Digest", F.col("payload_digest")),
        field("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return records.select("record_id", F.concat(F.encode(head, "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("warc"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, data[start:at]
        at += 4


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The derived records of all pages, with the length of each block and the text of conversions in place of the bytes."""
    made = derivatives(responses_of(pages))
    text = F.decode("block", "UTF-8")
    return made.select(
        "record_id",
        "record_type",
        "refers_to",
        "target_uri",
        "date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        "block_digest",
        "payload_digest",
        F.element_at("source_headers", "Content-Type").alias("source_content_type"),
        F.element_at("source_headers", "Content-Length").alias("source_content_length"),
        text.alias("content"),
    )
