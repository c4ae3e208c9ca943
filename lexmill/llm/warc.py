"""WARC derivative builder: from response records, linked metadata and plain-text conversion records.

A response record gives a metadata record (fields of the fetch and of the page: status, type,
charset, title, outlinks, and all other header fields of the record and of the HTTP response) and a conversion record (the page's plain text). Both name the response
by WARC-Refers-To; target URI, date and the response's digests go
on as source headers; each has its own block digest (sha1, base 32) and a record id derived from the
response's id. A response's id derives from its page's columns; where rows are repeated, from their
places in the table too, as ids must be unique. So a repeated run over the same files writes the same
records.

Records are values: header block, payload and digests. responses() reads them from WARC files, plain or
gzipped by record, from_pages() makes them from a table of pages, to_files() writes records back.
Files are read and written as streams, by URI (local files, HDFS, object stores), a record at a time.

Defined results: a response that isn't HTTP or not text gets a metadata record, and a conversion
record of empty text only if it is text; null html is an empty payload; a null URL has no target
URI header; repeated rows give records that differ in their ids only; texts of any length are kept whole; a damaged record in a file ends that file's reading
with the records before it; an empty table gives no rows; null page ids stay null; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialise, small_side
from .html_extract import INLINE, Node, parse

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # of responses that are made from a table, which states none
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, payload_digest string, "
    "source_block_digest string, source_payload_digest string, headers string, block binary"
)
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join('' if p is None else str(p) for p in parts))}>"


def header_block(fields: list[tuple[str, object]]) -> str:
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}" for k, v in fields if v is not None and v != ""]
    return "\r\n".join([VERSION, *lines]) + "\r\n\r\n"


def record(page, kind, rid, refers, uri, date, ctype, block, payload=None, source=(None, None)) -> tuple:
    """One row of RECORD. source: the block and payload digests of the response it comes from."""
    own, held = digest(block), digest(payload) if payload is not None else None
    headers = header_block(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", rid),
            ("WARC-Refers-To", refers),
            ("WARC-Target-URI", uri),
            ("WARC-Date", date),
            ("WARC-Block-Digest", own),
            ("WARC-Payload-Digest", held),
            ("WARC-Source-Block-Digest", source[0]),
            ("WARC-Source-Payload-Digest", source[1]),
            ("Content-Type", ctype),
            ("Content-Length", len(block)),
        ]
    )
    return (page, kind, rid, refers, uri, date, ctype, len(block), own, held, *source, headers, block)


def response(page, url: str | None, html: str | None, date: str = DATE, place: str | None = None) -> tuple:
    """place: tells rows apart that are equal otherwise."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    rid = record_id("response", page, url, digest(payload), *([place] if place else []))
    return record(page, "response", rid, None, url, date, "application/http; msgtype=response", head + payload, payload)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes] | None:
    """(status line, headers by lower-case name, payload); None if it isn't an HTTP response."""
    head, sep, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not sep or not lines[0].startswith("HTTP/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = _unchunk(body)
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47).decompress(body)
        except zlib.error:
            pass
    return lines[0], fields, body


def _unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        m = re.compile(rb"\s*([0-9a-fA-F]+)[^\r\n]*\r\n").match(body, at)
        if not m or not (n := int(m[1], 16)):
            return b"".join(out) if out or m else body
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n


def decode(payload: bytes, content_type: str) -> tuple[str, str]:
    """(text, charset): by the header, else by a meta element, else UTF-8."""
    m = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I) or re.search(r"<meta[^<>]+charset=[\"']?([\w.:-]+)", payload.decode("latin-1"), re.I)
    charset = m[1].lower() if m else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


_HIDDEN = frozenset("script style template noscript iframe head object embed svg".split())


def page_parts(html: str, base: str) -> tuple[str, str, list[str]]:
    """(title, plain text, outlinks): all visible text, a line a block; links in page order."""
    lines: list[str] = []
    run: list[str] = []
    title: list[str] = []
    links: dict[str, None] = {}

    def end() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            lines.append(text)
        run.clear()

    def walk(node: Node) -> None:
        for kid in node.kids:
            if isinstance(kid, str):
                run.append(kid)
            elif kid.tag == "title":
                title.append("".join(x for x in kid.kids if isinstance(x, str)))
            elif kid.tag == "head":
                for x in kid.kids:
                    if not isinstance(x, str) and x.tag == "title":
                        title.append("".join(t for t in x.kids if isinstance(t, str)))
            elif kid.tag in _HIDDEN:
                continue
            elif kid.tag == "br":
                end()
            elif kid.tag in INLINE:
                walk(kid)
            else:
                end()
                walk(kid)
                end()

    walk(parse(html))
    end()
    for m in re.finditer(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", html, re.I):
        href = unescape(next((x for x in m.groups() if x), "")).strip()
        try:
            links.setdefault(urljoin(base, href))
        except ValueError:
            links.setdefault(href)
    return " ".join(unescape(title[0]).split()) if title else "", "\n".join(lines), list(links)


#: Header fields of a response that its metadata record has in another way.
_OWN = frozenset("warc-type warc-record-id warc-target-uri warc-date warc-block-digest warc-payload-digest content-type content-length".split())


def source_headers(headers: str | None, block: bytes, http: bool) -> list[tuple[str, str]]:
    """The remaining header fields of a response record and of the HTTP response in it, as they stand."""
    lines = [x.strip() for x in (headers or "").split("\n")[1:]]
    out = [("warc-header", x) for x in lines if ":" in x and x.split(":")[0].strip().lower() not in _OWN]
    if http:
        out += [("http-header", x) for x in block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:] if x]
    return out


def derive(page, rid: str, uri: str | None, date: str, block: bytes, block_digest: str | None, payload_digest: str | None, headers: str | None = None) -> list[tuple]:
    """The metadata record and, for text, the conversion record of a response."""
    http = split_http(block)
    status, fields, payload = http or ("", {}, block)
    ctype = fields.get("content-type", "")
    kind = ctype.split(";")[0].strip().lower()
    source = (block_digest or digest(block), payload_digest or digest(payload))
    text = http is not None and (kind.startswith("text/") or kind in ("", "application/xhtml+xml", "application/xml"))
    notes: list[tuple[str, object]] = [("http-status", status.split(" ")[1] if status.count(" ") else None), ("content-type", kind or None)]
    plain = ""
    if text:
        body, charset = decode(payload, ctype)
        title, plain, links = page_parts(body, uri or "") if "html" in kind or not kind else ("", body, [])
        notes += [("charset", charset), ("title", title), ("text-digest", digest(plain.encode("utf-8", "surrogatepass")))]
        notes += [("outlink", x) for x in links]
    notes += source_headers(headers, block, http is not None)
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in notes if v not in (None, ""))
    out = [record(page, "metadata", record_id("metadata", rid), rid, uri, date, "application/warc-fields", lines.encode("utf-8", "surrogatepass"), None, source)]
    if text:
        out.append(record(page, "conversion", record_id("conversion", rid), rid, uri, date, "text/plain; charset=utf-8", plain.encode("utf-8", "surrogatepass"), None, source))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def from_pages(pages: DataFrame) -> DataFrame:
    """A response record for every row of a table of pages."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        for pdf in batches(it):
            again = pdf["again"].fillna(False) if "again" in pdf else [False] * len(pdf)
            rows = []
            for page, url, html, twice in zip(pdf["page_id"].array, pdf["url"].array, pdf["html"].array, again):
                rows.append(response(page, url, html, place=f"{part}/{k}" if twice else None))
                k += 1
            yield _frame(rows)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    key = F.xxhash64("page_id", "url", "html").alias("key")
    repeated = materialise(rows.groupBy(key).count().filter("count > 1").select("key", F.lit(True).alias("again")), "repeated")
    if not repeated.isEmpty():
        rows = rows.withColumn("key", key).join(small_side(repeated), "key", "left").drop("key")
    return rows.mapInPandas(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of every response among records."""
    need = ["page_id", "record_id", "target_uri", "date", "block", "block_digest", "payload_digest", "headers"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            rows = []
            for r in zip(*(pdf[c].array for c in need)):
                rows += derive(*r)
            yield _frame(rows)

    return records.filter(F.col("record_type") == "response").select(*need).mapInPandas(run, RECORD)


# --- files ---


def read_records(source: bytes | io.RawIOBase) -> Iterator[tuple]:
    """Rows of RECORD from a WARC file, gzipped or not: its bytes, or a stream of them."""
    stream = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source, 1 << 20)  # type: ignore[arg-type]
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)  # type: ignore[assignment]
    try:
        while True:
            line = stream.readline()
            while line and not line.strip():
                line = stream.readline()
            if not line.startswith(b"WARC/"):
                return
            fields: dict[str, str] = {}
            raw = [line]
            while (line := stream.readline()).strip():
                raw.append(line)
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            n = int(fields.get("content-length", "0"))
            block = stream.read(n)
            if len(block) < n:
                return
            get = fields.get
            yield (
                None, get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("content-type"), n,
                get("warc-block-digest"), get("warc-payload-digest"), get("warc-source-block-digest"), get("warc-source-payload-digest"), b"".join(raw).decode("utf-8", "replace") + "\r\n", block,
            )
    except (OSError, EOFError, ValueError, zlib.error):
        return


def _open(uri: str):
    """(file system, path) of a URI as Hadoop writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def responses(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files; a file is one task's, as record borders can't be found midway. Only the
    files' names go through the plan: their content is streamed in the tasks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            for uri in pdf["path"].array:
                files, name = _open(uri)
                rows: list[tuple] = []
                held = 0
                with files.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append(r)
                        held += r[7]
                        if len(rows) == 500 or held > 16 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, RECORD)


def to_files(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC members, one file for each partition. A task writes under another
    name first, so that one that is run again replaces its file whole."""
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    target = system.makeQualified(folder).toString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = _open(target)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        part, n = f"{folder}/.{uuid.uuid4().hex}", 0
        with files.open_output_stream(part, compression=None) as out:
            for pdf in batches(it):
                for h, b in zip(pdf["headers"], pdf["block"]):
                    out.write(gzip.compress(h.encode() + bytes(b) + b"\r\n\r\n", mtime=0))
                    n += 1
        files.move(part, name)
        yield pd.DataFrame({"file": [name], "records": [n]})

    records.select("headers", "block").mapInPandas(run, "file string, records long").write.format("noop").mode("overwrite").save()
