"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record holds an HTTP message.  For each one the builder makes a
``metadata`` record (its fields in ``application/warc-fields``) and a
``conversion`` record (the page's text), both with ``WARC-Refers-To`` the
response, its target URI and date, and digests of their own blocks; the
metadata also carries the source's payload and block digests and its HTTP
headers, so the derivative file stands without the source.  Record ids are
UUIDs derived from the response's id, so a rerun writes the same bytes.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: elements whose content is not markup and not text of the page; those whose content is markup but not text
_RAW = frozenset(("script", "style", "noscript", "iframe", "textarea", "xmp", "noembed", "noframes"))
_HIDDEN = frozenset(("template", "head", "svg", "select"))
#: elements that a head may hold; any other one ends it
_IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
#: elements that stand on lines of their own
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul body html title".split())
#: a whole tag; nothing is matched twice, so what is no tag costs one pass
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=[ \t\n\f\r]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def plain_text(page: str) -> str:
    """The visible text of an HTML page: blocks on lines, runs of white space as one space, no empty lines.

    One pass, as a browser reads: a comment, tag or script without an end hides
    all that follows; an unknown declaration ends at the next ``>``.
    """
    s = page.replace("\x00", "\ufffd")
    out: list[str] = []
    pos, hidden, depth = 0, "", 0
    while True:
        i = s.find("<", pos)
        if i < 0:
            if not hidden:
                out.append(s[pos:])
            break
        if not hidden:
            out.append(s[pos:i])
        next_ = s[i + 1 : i + 2]
        if next_.isascii() and (next_.isalpha() or next_ == "/" and s[i + 2 : i + 3].isascii() and s[i + 2 : i + 3].isalpha()):
            m = _TAG.match(s, i)
            if not m:
                break
            pos, name, ends = m.end(), m[2].lower(), bool(m[1])
            if hidden == "head" and (name == "head" and ends or name not in _IN_HEAD and name != "head"):
                hidden = ""
            elif hidden == name:
                depth += -1 if ends else 0 if m[3].endswith("/") else 1
                if not depth:
                    hidden = ""
                continue
            if not ends and name in _RAW:
                close = _end_of(name).search(s, pos)
                if not close:
                    break
                pos = close.start()
                if not hidden:
                    out.append(" ")
            elif hidden:
                pass
            elif name in _HIDDEN:
                if not ends and not (name == "svg" and m[3].endswith("/")):
                    hidden, depth = name, 1
                out.append(" ")
            elif name in _BLOCKS:
                out.append("\x00")
        elif next_ in ("!", "?", "/"):
            end, size = ("-->", 3) if s.startswith("<!--", i) else ("]]>", 3) if s.startswith("<![CDATA[", i) else (">", 1)
            j = s.find(end, i + 2)
            if j < 0:
                break
            pos = j + size
            if not hidden:
                out.append(" ")
        else:
            pos = i + 1
            if not hidden:
                out.append("<")
    # line breaks of the source are white space; the marks become the lines
    text = html.unescape("".join(out))
    lines = (" ".join(x.split()) for x in text.split("\x00"))
    return "\n".join(x for x in lines if x)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC 1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields, in lower case, and the block of a record; ValueError for what is no whole record.

    Of a field that is repeated the first one counts; a line that begins with
    white space goes on with the one before.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if not lines[0].startswith("WARC/") or not found:
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        fields.setdefault(k.strip().lower(), v.strip())
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or int(length) > len(rest):
        raise ValueError("no length, or a block that is cut short")
    return fields, rest[: int(length)]


def body_of(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings; as it is where it does not follow them, or they are unknown."""
    named = {}
    for k, v in headers:
        named.setdefault(k.lower(), v.lower())
    try:
        if "chunked" in named.get("transfer-encoding", ""):
            out, at = [], 0
            while True:
                end = payload.index(b"\r\n", at)
                n = int(payload[at:end].split(b";")[0], 16)
                if not n:
                    break
                out.append(payload[end + 2 : end + 2 + n])
                at = end + 4 + n
            payload = b"".join(out)
        for coding in reversed([x.strip() for x in named.get("content-encoding", "").split(",")]):
            if coding in ("gzip", "x-gzip"):
                payload = gzip.decompress(payload)
            elif coding == "deflate":
                try:
                    payload = zlib.decompress(payload)
                except zlib.error:
                    payload = zlib.decompress(payload, -15)
    except (ValueError, EOFError, OSError, zlib.error):
        pass
    return payload


def _id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(parts))}>"


def _line(value: str | None) -> str:
    """A field's value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def responses(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page, record): each page as a response record with an HTTP message, as a crawler stores it.

    A null page is an empty body, a null URL an empty target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, target, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (text or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                out.append(record(
                    [("WARC-Type", "response"), ("WARC-Record-ID", _id("response", str(key), target or "", hashlib.sha1(payload).hexdigest())), ("WARC-Date", DATE), ("WARC-Target-URI", _line(target)),
                     ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))],
                    block,
                ))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page", "record"])

    return pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.col(body).alias("html")).mapInArrow(run, "page long, record binary")


def derive(data: bytes | None) -> tuple[bytes, bytes] | None:
    """The metadata and the conversion record of a response record; None for other records and what is no whole record with an id."""
    try:
        fields, block = parse(data or b"")
    except ValueError:
        return None
    if fields.get("warc-type", "").lower() != "response" or not fields.get("warc-record-id"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = [tuple(x.strip() for x in line.split(":", 1)) for line in lines if ":" in line]
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    try:
        page = body_of(http, payload).decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):
        page = body_of(http, payload).decode("utf-8", "replace")
    text = plain_text(page).encode() if "html" in kind or not kind else page.encode()
    source = fields["warc-record-id"]
    common = [("WARC-Date", fields.get("warc-date", DATE)), ("WARC-Target-URI", fields.get("warc-target-uri", "")), ("WARC-Refers-To", source)]
    conversion_id, metadata_id = _id("conversion", source), _id("metadata", source)
    about = [("source-payload-digest", fields.get("warc-payload-digest") or digest(payload)), ("source-block-digest", fields.get("warc-block-digest") or digest(block)), ("source-content-length", str(len(block)))]
    about += [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http), ("conversion-record", conversion_id), ("conversion-digest", digest(text)), ("text-chars", str(len(text.decode())))]
    meta = "".join(f"{k}: {_line(v)}\r\n" for k, v in about).encode()
    metadata = record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), *common, ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(meta))], meta)
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *common, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(text)), ("WARC-Source-Metadata", metadata_id)], text)
    return metadata, conversion


def derivatives(records: DataFrame) -> DataFrame:
    """(page, metadata, conversion): two records for each response of records(page, record).

    Other record types, null records and what is no whole WARC record with an id
    and a length give no row.  A record that is repeated gives the same two
    records again, ids included.  Each record is derived by itself; nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, metas, texts = [], [], []
            for key, data in zip(batch.column("page").to_pylist(), batch.column("record").to_pylist(), strict=True):
                made = derive(data)
                if made:
                    pages.append(key)
                    metas.append(made[0])
                    texts.append(made[1])
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(metas, pa.binary()), pa.array(texts, pa.binary())], ["page", "metadata", "conversion"])

    return records.mapInArrow(run, "page long, metadata binary, conversion binary")


def gzipped(records: DataFrame) -> DataFrame:
    """(page, member): each derivative as gzip members, metadata first; concatenated they are a ``.warc.gz`` file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [gzip.compress(m, 6, mtime=0) + gzip.compress(c, 6, mtime=0) for m, c in zip(batch.column("metadata").to_pylist(), batch.column("conversion").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.binary())], ["page", "member"])

    return records.mapInArrow(run, "page long, member binary")


def digests(pages: DataFrame) -> DataFrame:
    """A row for each page, read back from its derivative records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "source_id", "metadata_id", "conversion_id", "target_uri", "refers_to_agree", "payload_digest", "text_digest", "text_sha256", "text_chars", "digests_agree"]
        for batch in batches:
            rows = []
            for key, m, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (mf, mb), (cf, cb) = parse(m), parse(c)
                about = dict(x.split(": ", 1) for x in mb.decode().split("\r\n") if x)
                rows.append((
                    key, cf["warc-refers-to"], mf["warc-record-id"], cf["warc-record-id"], cf["warc-target-uri"], mf["warc-refers-to"] == cf["warc-refers-to"] and about["conversion-record"] == cf["warc-record-id"],
                    about["source-payload-digest"], cf["warc-block-digest"], hashlib.sha256(cb).hexdigest(), len(cb.decode()), digest(cb) == cf["warc-block-digest"] == about["conversion-digest"] and digest(mb) == mf["warc-block-digest"],
                ))
            kinds = [pa.int64(), *[pa.string()] * 4, pa.bool_(), *[pa.string()] * 3, pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, source_id string, metadata_id string, conversion_id string, target_uri string, refers_to_agree boolean, payload_digest string, text_digest string, text_sha256 string, text_chars long, digests_agree boolean"
    return derivatives(responses(pages)).mapInArrow(run, schema)
