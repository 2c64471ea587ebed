"""WARC derivatives: linked metadata and plain-text conversion records (operator 10).

Each response gives a metadata record (its WARC and HTTP headers, title and links, as JSON) and a
conversion record (its text). Both refer to the response by its id, keep its target and date, and
carry its payload digest. Ids follow from the response's id, so reruns and retries agree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlint.llm.tokenfile import _open, as_uri
from ledgerlint.sources.tables import fresh_path, materialise

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")
DATE = "1970-01-01T00:00:00Z"  # of pages that come without a date
HIDING = re.compile(r"(?i)<(?:!--|(script|style|noscript|template|head)\b)")
CLOSERS = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "noscript", "template", "head", "title")}
BREAKS = re.compile(r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|blockquote|pre|hr|body|html)\b[^>]*>")
TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
TITLE = re.compile(r"(?i)<title")
LINKING = re.compile(r"(?i)<(a|img|link|script|iframe)\b")
ADDRESS = re.compile(r"""(?i)\s(href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
RUNS = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")
RECORDS = ("page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
           "content_type string, payload_digest string, block_digest string, content_length long, n_links long, block binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


class Ahead:
    """The next match of a pattern at or after growing positions; no stretch of the text is searched twice."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text = pattern, text
        self.since, self.found = 0, pattern.search(text)

    def __call__(self, at: int) -> re.Match | None:
        if self.found is not None and self.found.start() < at or at < self.since:
            self.since, self.found = at, self.pattern.search(self.text, at)
        return self.found


class Page:
    """Looks ahead in a page for the ends of tags, comments and elements, in time that grows with the page only."""

    def __init__(self, page: str):
        self.page, self.ahead = page, {}

    def next(self, name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        found = self.ahead.get(name)
        if found is None:
            found = self.ahead[name] = Ahead(pattern, self.page)
        return found(at)

    def element(self, name: str, at: int) -> tuple[int, int, int] | None:
        """(end of the opening tag, begin and end of the closing one) of an element whose name ends at ``at``."""
        tag = self.next(">", GREATER, at)
        close = tag and self.next(name, CLOSERS[name], tag.end())
        return (tag.end(), close.start(), close.end()) if close else None


GREATER, COMMENT_END = re.compile(">"), re.compile("-->")


def without_hidden(page: str) -> str:
    """Comments and elements that show no text become a blank."""
    look, out, at = Page(page), [], 0
    opening = HIDING.search(page)
    while opening:
        if opening[1]:
            found = look.element(opening[1].lower(), opening.end())
            end = found and found[2]
        else:
            found = look.next("-->", COMMENT_END, opening.end())
            end = found and found.end()
        if end:
            out += [page[at: opening.start()], " "]
            at = end
        opening = HIDING.search(page, end or opening.start() + 1)
    return "".join([*out, page[at:]])


def page_text(page: str) -> str:
    """Visible text: one line per block, white space collapsed, references resolved."""
    shown = without_hidden(page)
    last = shown.rfind(">") + 1  # no tag ends after it
    text = TAG.sub("", BREAKS.sub("\n", shown[:last])) + shown[last:]
    if "&" in text:
        text = html.unescape(text)
    return LINES.sub("\n", RUNS.sub(" ", text)).strip()


def page_links(page: str) -> list[dict]:
    """The first address in each linking tag, in order."""
    look, out = Page(page), []
    tag = LINKING.search(page)
    while tag:
        found = look.next("address", ADDRESS, tag.end())
        if found is None:
            break
        close = look.next(">", GREATER, tag.end())
        inside = close is None or found.start() < close.start()
        if inside:
            out.append({"path": f"{tag[1].upper()}@/{found[1].lower()}", "url": html.unescape(found[2].strip("\"'"))})
        tag = LINKING.search(page, found.end() if inside else tag.end())
    return out


def page_title(page: str) -> str:
    look, opening = Page(page), TITLE.search(page)
    while opening:
        found = look.element("title", opening.end())
        if found:
            return html.unescape(page[found[0]: found[1]]).strip()
        closing = look.ahead.get("title")
        if closing is None or closing.found is None:  # nothing ends a tag, or a title, from here on
            return ""
        opening = TITLE.search(page, opening.end())
    return ""


def derivatives(page_id, url, date, headers, payload: str | None) -> list[tuple]:
    """The two records of a response, as rows of RECORDS. ``headers`` is the HTTP header block, kept
    line by line; a null payload is empty, a null url an empty target."""
    url, payload, date = url or "", payload or "", date or DATE
    raw = payload.encode()
    headers = headers or f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n"
    response, of_payload = urn("response", str(page_id), url, date, digest(raw)), digest(raw)
    lines = [line for line in headers.split("\r\n") if line]
    fields = [line.split(":", 1) for line in lines[1:] if ":" in line]
    links = page_links(payload)
    envelope = {
        "WARC-Header-Metadata": {"WARC-Type": "response", "WARC-Record-ID": response, "WARC-Target-URI": url,
                                 "WARC-Date": date, "WARC-Payload-Digest": of_payload},
        "Payload-Metadata": {"HTTP-Response-Metadata": {
            "Response-Message": lines[0] if lines else "", "Headers": {k.strip(): v.strip() for k, v in fields},
            "HTML-Metadata": {"Title": page_title(payload), "Links": links}}}}
    blocks = [("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=False).encode()),
              ("conversion", "text/plain", page_text(payload).encode())]
    return [(page_id, kind, urn(kind, response), response, url, date, media, of_payload, digest(block), len(block),
             len(links), block) for kind, media, block in blocks]


def record_bytes(row: dict) -> bytes:
    """A row of RECORDS as a WARC/1.1 record."""
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}",
            f"WARC-Refers-To: {row['refers_to']}", f"WARC-Target-URI: {row['target_uri']}", f"WARC-Date: {row['warc_date']}",
            f"WARC-Payload-Digest: {row['payload_digest']}", f"WARC-Block-Digest: {row['block_digest']}",
            f"Content-Type: {row['content_type']}", f"Content-Length: {row['content_length']}"]
    clean = "\r\n".join(re.sub(r"[\r\n]+", " ", line) for line in head)
    return clean.encode() + b"\r\n\r\n" + row["block"] + b"\r\n\r\n"


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                    for n, t in (x.split() for x in RECORDS.split(", "))])


def _responses(pages: DataFrame) -> DataFrame:
    """page_id, url, warc_date, http_headers, html; the middle two may be absent."""
    absent = lambda name: (F.col(name) if name in pages.columns else F.lit(None)).cast("string").alias(name)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), absent("warc_date"),
                        absent("http_headers"), F.col("html").cast("string"))


def derive(pages: DataFrame) -> DataFrame:
    """The metadata and conversion records (RECORDS) of every row of a page table."""
    def derived(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k in range(0, batch.num_rows, 500):
                rows = [r for page in zip(*[c[k: k + 500] for c in columns]) for r in derivatives(*page)]
                if rows:
                    yield _batches(rows, _ARROW)

    return _responses(pages).mapInArrow(derived, RECORDS)


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write the derivatives as gzipped WARC files, a member per record, one file per task, to a
    folder all executors share. Returns the index of what was written: RECORDS without the block,
    and file, offset and length of each member. Files of failed tasks are not in the index."""
    folder = as_uri(folder)
    index = [f for f in _ARROW if f.name != "block"] + [pa.field("file", pa.string()), pa.field("offset", pa.int64()),
                                                         pa.field("length", pa.int64())]
    schema = pa.schema(index)

    def written(batches: Iterator[pa.RecordBatch]):
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = []
            for page in zip(*columns):
                for row in derivatives(*page):
                    member = gzip.compress(record_bytes(dict(zip(_ARROW.names, row))), 3, mtime=0)
                    if out is None:
                        out = _open(path, "write")
                    out.write(member)
                    rows.append((*row[:-1], path, at, len(member)))
                    at += len(member)
            if rows:
                yield _batches(rows, schema)
        if out is not None:
            out.close()

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return materialise(_responses(pages).mapInArrow(written, ", ".join(f"{f.name} {kinds[f.type]}" for f in index)), "warc-index")


def read_member(path: str, offset: int, length: int) -> bytes:
    """One record of a written file."""
    with _open(path, "read") as source:
        source.seek(offset)
        return gzip.decompress(source.read(length))


def warc_digest(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the derivatives of all pages; one row per record as indexed. A null url or page counts
    as an empty one, repeated rows give equal records, an empty table gives none."""
    index = write_warc(pages, folder or fresh_path(pages.sparkSession, "warc"))
    return index.drop("file", "offset", "length")
