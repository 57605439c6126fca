"""Operator 9: WARC derivatives.

Every response record yields two records linked to it: a metadata record that
repeats the response's identifiers, HTTP status, headers and digests as fields,
and a conversion record with the page as plain text. Both name the response in
WARC-Refers-To and keep its target, date and payload digest.

A record that is null, not a response, or not parsable yields no derivatives and
is reported with its reason by ``rejected``; a digest that does not match its
block is kept as found and flagged. Empty bodies give an empty conversion. Every
occurrence of a repeated record yields its own pair with the same identifiers. An
empty table gives no rows; records of any length are read whole; columns kept from
the input come as struct ``_row``, so no name in them can clash with the results.

Chunked bodies are joined and gzip and deflate bodies unpacked before the text is
read; digests are those of the bodies as stored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_text
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import prepare

VERSION = b"WARC/1.1"
END = b"\r\n"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 9562
# Fixed HTML vocabulary: elements that end a line of text, and those whose content is no text of the page.
_BREAKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "noscript", "template")}
# Without an end tag these hide the rest of the page, as browsers read it; the last two then hide nothing.
_TO_THE_END = frozenset(_HIDDEN) - {"noscript", "template"}
_OPENING = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_PLAIN_PART = re.compile(r"[^>=]*")
_VALUE = re.compile(r"\s*+(?:[\"']|[^\s>]*+)")
_LINE_ENDS = re.compile(r"[\r\n\f]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A serialised record; Content-Length and WARC-Block-Digest are added."""
    lines = [VERSION]
    for name, value in [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]:
        lines.append(f"{name}: {value}".encode())
    return END.join(lines) + END + END + block + END + END


def fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines as (name, value); a line that starts with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in head.split(END):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse(raw: bytes | None) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one serialised record, gzipped or not; ValueError says what is wrong."""
    if raw is None:
        raise ValueError("null record")
    raw = bytes(raw)
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"broken gzip: {e}") from None
    head, gap, rest = raw.partition(END + END)
    version, _, head = head.partition(END)
    if not gap or not version.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    headers = fields(head)
    length = get(headers, "Content-Length")
    if length is None or not length.isdigit() or int(length) > len(rest):
        raise ValueError("bad Content-Length")
    return headers, rest[: int(length)]


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response(url: str, date: str, body: bytes, key: str) -> bytes:
    """A response record for a page; its identifier is derived from ``key`` and the url."""
    http = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()])
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key} {url}')}>"),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest(body)),
    ], http + END + END + body)


def _tag_end(page: str, at: int) -> int:
    """The place after a tag's ``>``, outside of quoted values; the page's end if there is none."""
    while True:
        at = _PLAIN_PART.match(page, at).end()
        if at >= len(page):
            return at
        if page[at] == ">":
            return at + 1
        value = _VALUE.match(page, at + 1)
        at = value.end()
        if value[0][-1:] in ("'", '"') and value[0].strip() in ("'", '"'):
            at = page.find(page[at - 1], at) + 1 or len(page)


def plain_text(page: str) -> str:
    """The text of a page, a line for each block-level element (and each line of a pre element).

    One pass, in time linear in the page's length. White space within a line becomes one space.
    """
    out, at, endless, kept_lines = [], 0, set(), 0

    def add(text: str) -> None:
        text = html_text.unescape(text)
        out.append(text if kept_lines else _LINE_ENDS.sub(" ", text))

    while (found := page.find("<", at)) >= 0:
        add(page[at:found])
        tag = _OPENING.match(page, found + 1)
        if tag is None:
            if page.startswith("<!--", found):
                at = page.find("-->", found + 2) + 3  # <!--> is a whole comment
                at = at if at > 2 else len(page)
            elif page[found + 1 : found + 2] in ("!", "?", "/"):
                at = page.find(">", found + 1) + 1 or len(page)
            else:
                out.append("<")
                at = found + 1
            continue
        at = _tag_end(page, tag.end())
        name = tag[2].lower()
        if name in _BREAKS:
            out.append("\n")
        if name == "pre":
            kept_lines = max(0, kept_lines + (-1 if tag[1] else 1))
        if not tag[1] and name in _HIDDEN and name not in endless:
            end = _HIDDEN[name].search(page, at)
            if end:
                at = end.start()
            elif name in _TO_THE_END:
                at = len(page)
            else:
                endless.add(name)
    add(page[at:])
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(END, at)
        try:
            size = int(data[at:end].partition(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("broken chunks")
        if size == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def decoded(http: list[tuple[str, str]], stored: bytes) -> tuple[bytes, bytes]:
    """The payload (without transfer coding) and the document (without content codings) of a stored body."""
    payload = _unchunked(stored) if "chunked" in (get(http, "Transfer-Encoding") or "").lower() else stored
    body = payload
    for coding in reversed([c.strip().lower() for c in (get(http, "Content-Encoding") or "").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
            elif coding not in ("", "identity"):
                raise ValueError(f"unknown content coding: {coding}")
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"broken {coding} body: {e}") from None
    return payload, body


def derive(raw: bytes) -> list[dict]:
    """The metadata and the conversion record of a response, as rows with the serialised record."""
    headers, block = parse(raw)
    if (kind := get(headers, "WARC-Type")) != "response":
        raise ValueError(f"not a response: {kind}")
    source = get(headers, "WARC-Record-ID")
    if not source:
        raise ValueError("no record id")
    head, _, stored = block.partition(END + END)
    status, _, head = head.partition(END)
    http = fields(head)
    unchunked, body = decoded(http, stored)
    charset = re.search(r"charset=[\"']?([\w.-]+)", get(http, "Content-Type") or "", re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    own_digest = digest(stored)
    payload = get(headers, "WARC-Payload-Digest") or own_digest
    intact = payload == own_digest or (unchunked is not stored and payload == digest(unchunked))
    url, date = get(headers, "WARC-Target-URI") or "", get(headers, "WARC-Date") or ""
    text = plain_text(page).encode()
    notes = [("source-record-id", source), ("source-payload-digest", payload)]
    notes += [("source-block-digest", v)] if (v := get(headers, "WARC-Block-Digest")) else []
    notes += [("http-status", status.decode("utf-8", "replace"))] + [(f"http-header-{k.lower()}", v) for k, v in http]
    notes += [("text-bytes", str(len(text)))]
    rows = []
    for kind, content_type, data in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in notes).encode()),
                                     ("conversion", "text/plain; charset=utf-8", text)):
        own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{source} {kind}')}>"
        linked = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
                  ("WARC-Refers-To", source), ("Content-Type", content_type)]
        linked += [("WARC-Payload-Digest", digest(data))] if kind == "conversion" else []
        linked += [("WARC-Source-Payload-Digest", payload)]
        rows.append({
            "record_type": kind, "record_id": own, "refers_to": source, "target_uri": url, "warc_date": date,
            "source_payload_digest": payload, "source_digest_ok": intact, "block_digest": digest(data),
            "block_bytes": len(data), "record": record(linked, data),
        })
    return rows


ROW = ("record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
       "source_payload_digest string, source_digest_ok boolean, block_digest string, block_bytes long, record binary")


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
_FIELDS = [(c.split()[0], _ARROW[c.split()[1]]) for c in ROW.split(", ")]


def _derived(batch: pa.RecordBatch, records: Iterator[bytes | None]) -> pa.RecordBatch:
    """The batch's ``_row`` column, repeated for each row that its records yield, and the rows' columns."""
    at, rows = [], []
    for i, raw in enumerate(records):
        try:
            found = derive(raw)
        except ValueError:
            continue
        at += [i] * len(found)
        rows += found
    kept = batch.column("_row").take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([kept, *(pa.array([r[n] for r in rows], t) for n, t in _FIELDS)], ["_row", *(n for n, _ in _FIELDS)])


def _kept(frame: DataFrame, keep: list[str]):
    return F.struct(*[F.col(c) for c in keep]).alias("_row")


def _map(source: DataFrame, run) -> DataFrame:
    return source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, {ROW}")


def derivatives(responses: DataFrame, keep: list[str], record_col: str = "record") -> DataFrame:
    """Two rows per response: its ``keep`` columns as struct ``_row``, the linking fields and the serialised ``record``.

    Records are parsed once, in one Python step; what yields nothing gives no row.
    """
    prepare(responses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _derived(batch, (r.as_py() for r in batch.column("_record")))

    return _map(responses.select(_kept(responses, keep), F.col(record_col).alias("_record")), run)


def page_derivatives(pages: DataFrame, keep: list[str], date: str, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """The derivatives of every page's response (as ``responses_of`` builds it), without the response leaving its task."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c) for c in ("_url", "_html", "_key")))
            yield _derived(batch, (response(u.as_py(), date, h.as_py().encode(), k.as_py()) for u, h, k in columns))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return _map(pages.select(_kept(pages, keep), text(url).alias("_url"), text(html).alias("_html"), text(key).alias("_key")), run)


def rejected(responses: DataFrame, keep: list[str], record_col: str = "record") -> DataFrame:
    """The ``keep`` columns as struct ``_row`` and the ``reason`` of the records that yield no derivatives."""
    prepare(responses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, reasons = [], []
            for i, raw in enumerate(batch.column("_record")):
                try:
                    derive(raw.as_py())
                except ValueError as e:
                    at.append(i)
                    reasons.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(at, pa.int64())), pa.array(reasons, pa.string())], ["_row", "reason"])

    source = responses.select(_kept(responses, keep), F.col(record_col).alias("_record"))
    return source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, reason string")


def responses_of(pages: DataFrame, keep: list[str], date: str, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """``keep`` columns of every page as struct ``_row`` with ``record``, its serialised response (null html: an empty body)."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u.as_py(), date, h.as_py().encode(), k.as_py()) for u, h, k in zip(*(batch.column(c) for c in ("_url", "_html", "_key")))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(made, pa.binary())], ["_row", "record"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = pages.select(_kept(pages, keep), text(url).alias("_url"), text(html).alias("_html"), text(key).alias("_key"))
    return source.mapInArrow(run, f"_row {source.schema['_row'].dataType.simpleString()}, record binary")
