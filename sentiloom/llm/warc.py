"""WARC archives: written by tasks, read back record by record.

Writer: each task appends records to a file of its own in a shared folder, one gzip member per record, and starts the next file
after ``FILE_BYTES``.  File names hold a random part, and only files that a finished task reports are in the manifest, so a repeated
or lost task leaves nothing that is read.  Files go through ``pyarrow.fs``, which also knows remote stores.

Reader: a file is read in pieces of 1 MB and inflated incrementally, one decompressor per gzip member; the header ends at the first empty line,
``Content-Length`` frames the block, and block and payload digests are verified.  Memory is bounded by the largest record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import stored, table
from sentiloom.llm.registry import llm_query
from sentiloom.session import scratch_path

FILE_BYTES = 64 << 20
MOST_TASKS = 50_000
LEAST_SHARED = 100  # shorter payloads are never revisits
_PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps reruns equal


def open_store(path: str):
    from pyarrow import fs

    path = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _uri(value: str) -> str:
    """Header values hold no control characters; others are percent-encoded reversibly enough for a log line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member.  A revisit has the HTTP header alone; its digest and length are those of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def members(stream) -> Iterator[bytes]:
    """Inflated gzip members of a file, one by one."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        piece = rest or stream.read(_PIECE)
        rest = b""
        if not piece:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(inflate.decompress(piece))
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []


def parse_record(data: bytes) -> dict:
    """Header fields, block and payload of one record; ``valid`` tells whether framing and digests agree."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    valid = len(block) == size and data[end + 4 + size :] == b"\r\n\r\n" and "sha256:" + hashlib.sha256(block).hexdigest() == fields["warc-block-digest"]
    valid &= revisit or "sha256:" + hashlib.sha256(payload).hexdigest() == fields["warc-payload-digest"]
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    fields.update(payload=None if revisit else payload, payload_bytes=int(length.group(1)) if revisit else len(payload), valid=valid)
    return fields


def with_revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, payload, payload_bytes, digest, refers_to (null for responses).

    Only digests met twice or more are joined back, by a plain join that adaptive execution splits on a hot digest; a revisit
    carries no payload on.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(F.col("digest").alias("_digest"), "first_id")
    joined = rows.join(shared, rows["digest"] == shared["_digest"], "left")
    refers = F.when(F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("first_id") != F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``records`` of :func:`with_revisits` below ``folder``; returns the manifest (path, records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [size]})

        for batch in batches:
            for row in zip(*[batch.column(n) for n in ("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")]):
                page_id, url, payload, n, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None), 0, 0
                data = write_record(page_id, url, payload or b"", n, digest, refers_to, refers_to is not None)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stored(records.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the listed files: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, valid."""

    def page(field: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", field or "")
        return int(found.group(1)) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for b in batches for p in b.column("path")):
            store, name = open_store(path)
            rows, size = [], 0
            with store.open_input_stream(name, compression=None) as stream:
                for data in members(stream):
                    r = parse_record(data)
                    rows.append({
                        "page_id": page(r["warc-record-id"]), "url": r.get("warc-target-uri"), "record_type": r["warc-type"], "refers_to": page(r.get("warc-refers-to")),
                        "payload_bytes": r["payload_bytes"], "payload_digest": r["warc-payload-digest"].removeprefix("sha256:"), "payload": r["payload"], "valid": r["valid"]})
                    size += len(data)
                    if size >= _PIECE * 4:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary()), ("valid", pa.bool_())])
    # a fixed number of partitions: by their own few bytes, adaptive execution would put all paths into one task
    parts = min(max(1, manifest.count()), MOST_TASKS)
    return manifest.select("path").repartition(parts, "path").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, valid boolean")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive record per row of ``pages`` and read the archives back.

    A null html is an empty payload; a null url leaves the header out; a page without an id is always a response; rows that repeat an
    id and a payload are all responses when the id is the smallest.  An empty table gives no files and no rows.  Other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder))


_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND first_id <> page_id THEN first_id END AS refers_to, true AS valid FROM m
"""


@llm_query("op6_warc", _SQL)
def op6_warc(spark, folder):
    return round_trip(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
