"""WARC archives: writing, normalising monolithic gzip files, reading back.

Pages become WARC records: a response with the payload, or, for a page whose
payload of at least REVISIT_FROM bytes equals that of a page with a larger id, a
revisit that refers to the largest such id. Records are packed into archives of
about ARCHIVE_BYTES, each one gzip stream over the whole file, which can only be
read from its start. The normaliser inflates such a stream once, rewrites every
record as its own gzip member, and writes a sidecar index of offsets, so that
any record can be fetched alone. Archives and indexes are rows of binary columns
in tables in the shared folder, which every executor can read by any path.

A record's block is the HTTP response; a revisit has its head only. Record ids
are UUIDs worked out from the page id (X-Page-ID), payload digests are SHA-1 in
base 32, as other readers expect.

Records, digests and who refers to whom are settled with DataFrame operations
(a partial aggregation by digest and a join, in which the rows of a payload that
a third of all pages share are dealt over several tasks).

Defined results: a null html is an empty payload, a null url an empty one; a null
id is written without a page id, comes back as null, and is never referred to
while its payload has another id. Rows that repeat an id and payload: each is
written (under one record id); those that hold the largest id are responses.
Empty tables give no archives and no rows.
"""

from __future__ import annotations

import base64
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, meet, scratch, stage_table

REVISIT_FROM, ARCHIVE_BYTES, LEVEL = 1000, 8_000_000, 3
NO_URL = "about:blank"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def planned(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, payload, digest, size, refers_to)."""
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    copies = rows.filter(F.col("size") >= REVISIT_FROM).select("id", "digest").groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    copies = stage_table(copies, "warc-copies")
    kinds, copied = copies.agg(F.count(F.lit(1)), F.sum("size")).first()
    rows = rows.withColumnRenamed("size", "bytes")
    if kinds <= BROADCAST_ROWS:  # few digests repeat, as a rule: then no payload is shuffled
        again = rows.join(F.broadcast(copies.drop("size")), "digest", "left")
    else:
        again = meet(rows, copies, "digest", F.monotonically_increasing_id(), copied, "left")
    return again.select("id", "url", "payload", "digest", F.col("bytes").alias("size"), F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid4() if page is None else uuid5(NAMESPACE_URL, f'page:{page}')}>"


def record(page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; digest in hexadecimal. A revisit has no payload of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url or NO_URL}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    lines = [re.sub(r"[\r\n]", " ", h) for h in head]
    return "\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def pack(rows: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): monolithic gzip files of planned rows."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit():
            out.write(deflate.flush())
            return pa.RecordBatch.from_arrays([pa.array([uuid4().hex]), pa.array([out.getvalue()], pa.binary())], ["archive", "content"])

        out, deflate, held = io.BytesIO(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        for batch in batches:
            for row in batch.to_pylist():
                page, other = (None if row[c] is None else str(row[c]) for c in ("id", "refers_to"))
                data = record(page, row["url"], row["payload"], row["digest"], other, date)
                out.write(deflate.compress(data))
                held += len(data)
                if held >= size:
                    yield emit()
                    out, deflate, held = io.BytesIO(), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        if held:
            yield emit()

    return rows.mapInArrow(run, "archive string, content binary")


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the bytes of an uncompressed WARC file, in pieces."""
    held = bytearray()
    need, done = 0, False
    while True:
        if not need:
            end = held.find(b"\r\n\r\n")
            if end >= 0:
                length = re.search(rb"(?im)^Content-Length:\s*(\d+)", held[: end + 2])
                if not held.startswith(b"WARC/") or not length:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(length[1]) + 4
        if need and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = 0
            continue
        if done:
            if held:
                raise ValueError("the archive ends inside a record")
            return
        piece = next(stream, None)
        if piece is None:
            done = True
        else:
            held += piece


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """A gzip file's bytes, read once from its start; also of several members."""
    inflate = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        piece = content[at : at + step]
        while piece:
            yield inflate.decompress(piece)
            piece = inflate.unused_data
            if inflate.eof:
                if not piece:
                    break
                inflate = zlib.decompressobj(31)
            else:
                piece = b""


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content: one gzip member for each record, offsets: the sidecar
    index as an array of (record_id, start, length))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("record_id", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                out, index = io.BytesIO(), []
                for data in records_of(inflated(content.as_buffer())):
                    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    start = out.tell()
                    out.write(deflate.compress(data) + deflate.flush())
                    index.append({"record_id": fields_of(data)[0].get("warc-record-id"), "start": start, "length": out.tell() - start})
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue()], pa.binary()), pa.array([index], pa.list_(entry))], ["archive", "content", "offsets"])

    return archives.mapInArrow(run, "archive string, content binary, offsets array<struct<record_id: string, start: long, length: long>>")


def fields_of(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[:-4]


def fetch(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record, fetched by its index entry: (page_id, url, record_type,
    payload: null for a revisit, payload_bytes, payload_digest, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist(), strict=True):
                content, rows = content.as_buffer(), []
                for at in offsets:
                    fields, block = fields_of(zlib.decompress(content.slice(at["start"], at["length"]), 31))
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit, url = fields["warc-type"] == "revisit", fields["warc-target-uri"]
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if not revisit and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{at['record_id']}: the payload differs from its digest")
                    size = int(re.search(rb"(?i)\nContent-Length: (\d+)", http)[1])
                    rows.append((fields.get("x-page-id"), "" if url == NO_URL else url, fields["warc-type"], None if revisit else body, size, digest, fields.get("x-refers-to-page-id")))
                kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    out = archives.mapInArrow(run, "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Writes pages as monolithic archives, normalises them, and reads every
    record back by its index."""
    with scratch() as made:
        packed = stage_table(pack(planned(pages, id_column, url_column, html_column)), "warc-whole")
        members = stage_table(normalise(packed), "warc-members")
        made.release(members)
    return fetch(members, pages.schema[id_column].dataType.simpleString())
