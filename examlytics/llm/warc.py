"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` turns fetched pages into WARC/1.0 response records, ``read_records`` parses the bytes
of WARC files.  ``derive`` makes two records of every response:

* a metadata record with a JSON body: the source's WARC headers, its HTTP status and headers, the page
  title and its links.  ``source_fields`` and the HTTP headers are [name, value] pairs in the source's order, so
  repeated fields all stay; ``source`` is the same by name, with the last value of a repeated one;
* a conversion record whose body is the page's plain text (all visible blocks, a line each).

Both keep the source's target URI and date and point to it by WARC-Refers-To; the conversion also
names the metadata record as concurrent.  Payload and block digests are base-32 SHA-1.  Record
ids are UUIDs derived from the source id and the kind, so a task that is run again makes the same records.

Defined cases: a record that is not a response gives no derivatives.  A missing or broken HTTP head leaves status and
headers empty and the whole block as payload.  Null html is an empty payload, a null url an empty
target URI.  Repeated rows give repeated records with equal ids.  Bytes that are not UTF-8 are replaced when
text is made; digests are over the bytes as they are.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .html_blocks import read

VERSION = "WARC/1.0"
#: Pages carry no fetch time; responses made of them get this one.
NO_DATE = "1970-01-01T00:00:00Z"
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


#: Type of the row that stands for a record that cannot be read.
BROKEN = "broken"


def to_bytes(headers: Headers, block: bytes) -> bytes:
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def split_head(data: bytes, at: int = 0) -> tuple[str, Headers, int]:
    """First line, header fields and the place behind the blank line; continued lines are joined."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("a record's head does not end")
    first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
    fields: Headers = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return first, fields, end + 4


def field(headers: Headers, name: str) -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), "")


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Records of the bytes of an uncompressed WARC file; a ValueError where no whole record follows."""
    at = 0
    while at < len(data):
        version, headers, body = split_head(data, at)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts at {at}")
        size = int(field(headers, "Content-Length"))
        if size < 0 or body + size > len(data):
            raise ValueError(f"the record at {at} is cut short")
        yield [h for h in headers if h[0].lower() != "content-length"], data[body:body + size]
        at = body + size + 4


def record_end(data: bytes, at: int) -> int:
    """Where the record that starts at ``at`` ends, with its two line breaks."""
    version, headers, body = split_head(data, at)
    size = int(field(headers, "Content-Length"))
    if not version.startswith("WARC/") or size < 0 or body + size > len(data):
        raise ValueError(f"no whole record at {at}")
    return min(body + size + 4, len(data))


def response(url: str, page: str, date: str = NO_DATE) -> tuple[Headers, bytes]:
    payload = page.encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, date, digest(payload))), ("WARC-Target-URI", url),
            ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response")], block


def derivatives(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response; none of any other record."""
    if field(headers, "WARC-Type") != "response":
        return []
    try:
        status, http, at = split_head(block)
        if not status.startswith("HTTP/"):
            raise ValueError("no HTTP head")
    except ValueError:
        status, http, at = "", [], 0
    payload = block[at:]
    page = read(payload.decode("utf-8", "replace"))
    source = field(headers, "WARC-Record-ID")
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    text = "".join(f"{b.text}\n" for b in page.blocks).encode("utf-8", "replace")
    facts = json.dumps({"source": dict(headers), "source_fields": headers, "http": {"status": status, "headers": http}, "payload": {
        "length": len(payload), "digest": digest(payload)}, "html": {"title": page.title, "links": [u for u, _ in page.links]}},
        ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")

    def made(kind: str, mime: str, body: bytes) -> tuple[Headers, bytes]:
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source),
               ("WARC-Target-URI", field(headers, "WARC-Target-URI")), ("WARC-Date", field(headers, "WARC-Date"))]
        if kind == "conversion":
            own.append(("WARC-Concurrent-To", ids["metadata"]))
        return [*own, ("WARC-Source-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body

    return [made("metadata", "application/json", facts), made("conversion", "text/plain", text)]


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with all columns and ``record``: the bytes of a response record (a column of this name is replaced)."""
    pages = pages.drop("record") if "record" not in (url_col, html_col) else pages
    src = pages.select("*", F.coalesce(F.col(url_col), F.lit("")).alias("__url"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    schema = pages.select("*", F.lit(b"").alias("record")).schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = [to_bytes(*response(u, h)) for u, h in zip(batch.column("__url").to_pylist(), batch.column("__html").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(records, pa.binary())], names=[*batch.schema.names[:-2], "record"])

    return map_batches(src, made, schema)


def read_records(files: DataFrame) -> DataFrame:
    """(path, record) of every record of WARC files, from Spark's ``binaryFile`` source (one uncompressed file a row)."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw, at = data.as_py() or b"", 0
                while at < len(raw):
                    try:
                        end = record_end(raw, at)
                    except ValueError:
                        end = len(raw)             # what follows a broken record is kept as one, which derive marks
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([raw[at:end]], pa.binary())], names=["path", "record"])
                    at = end

    return map_batches(files.select("path", "content"), split, "path string, record binary")


def derive(records: DataFrame, id_col: str, record_col: str = "record") -> DataFrame:
    """(id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, content_length, record).  A record that cannot be
    read (no WARC head, a missing or wrong length, cut short) gives one row of type ``broken`` without a record; the others go on."""
    src = records.select(F.col(id_col).alias("__id"), F.col(record_col).alias("__record"))
    kind = src.schema["__id"].dataType.simpleString()
    named = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
             "source_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest"}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                row, found = [], []
                for i, data in enumerate(batch.column("__record").to_pylist()):
                    try:
                        for headers, block in parse(data or b""):
                            for made_ in derivatives(headers, block):
                                row.append(i)
                                found.append(made_)
                    except ValueError:
                        row.append(i)
                        found.append(([("WARC-Type", BROKEN)], b""))
                columns = [pa.array([field(h, name) for h, _ in found], pa.string()) for name in named.values()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id").take(pa.array(row, pa.int64())), *columns, pa.array([len(b) for _, b in found], pa.int64()),
                     pa.array([None if field(h, "WARC-Type") == BROKEN else to_bytes(h, b) for h, b in found], pa.binary())], names=["__id", *named, "content_length", "record"])

    return map_batches(src, made, f"__id {kind}, {', '.join(f'{c} string' for c in named)}, content_length bigint, record binary"
                       ).withColumnRenamed("__id", id_col)


def op9_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return derive(responses(pages), "page_id").withColumn("record_sha256", F.sha2("record", 256)).drop("record")
