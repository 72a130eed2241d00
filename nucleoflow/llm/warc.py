"""Web archives: compressed records, an index of byte ranges, and coalesced reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nucleoflow.llm.common import NULL_ID, long_id, partitions, null_back, shared_folder

ARCHIVE_BYTES = 64 << 20
#: Ranges closer than this are read at once; a read stays below READ_BYTES unless one record is longer.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
INDEX = pa.schema(
    [
        ("page_id", pa.int64()),
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
    ]
)
INDEX_DDL = "page_id long, path string, offset long, length long, url string, digest string, record_type string"
PARSED = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
PARSED_DDL = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


#: Date of records whose pages have none; not the time of writing, which no page was captured at.
UNDATED = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str, date: str = UNDATED) -> bytes:
    """One record; a response's block is an HTTP message, a revisit has no block, only its headers.

    ``place`` is where the record starts, as archive:offset. It makes ids of
    repeated pages differ. A revisit names the page it refers to in a header of
    its own, as no other record's place is known when it is written.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}:{place}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
    block = _HTTP % len(payload) + payload if refers_to is None else b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    kind = fields["WARC-Type"]
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} differs")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["WARC-Record-ID"].split(":")[2]),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None,
        "payload": payload,
    }


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): the smallest page_id of equal payloads is referred to.

    Only digests are grouped and joined; the payload joins its row's decision by page_id.
    """
    rows = pages.select(
        long_id("page_id").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    light = rows.select("page_id", "sha1", (F.octet_length("payload") >= min_bytes).alias("counts")).distinct()
    first = light.where("counts").groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    later = light.where("counts").join(first.where("n > 1"), "sha1").where("page_id <> first").select("page_id", "sha1", "first")
    return rows.join(later, ["page_id", "sha1"], "left").select(
        "page_id", "url", "payload", "sha1", F.col("first").alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write every page as a record to archives below ``folder`` and their index to ``folder``/index.

    Each record is a gzip member, so a byte range can be read alone. A task
    writes archives with names of its own; an attempt that is lost leaves files
    which no index row names. Null html counts as empty, a null url has no
    header, repeated page_ids are records each, with ids of their own; no page,
    no archive. The table has no dates, so all records bear UNDATED.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, payload, sha1, refers_to in zip(*columns, strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, f"{path}:{at}"), 3, mtime=0)
                out.write(data)
                rows.append((page_id, path, at, len(data), url, digest, "response" if refers_to is None else "revisit"))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), INDEX, strict=True)], schema=INDEX)
        if out is not None:
            out.close()

    folder = _uri(folder)
    decide(pages, min_bytes).mapInArrow(write, INDEX_DDL).write.parquet(f"{folder}/index")


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{_uri(folder)}/index")


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Parsed records of the ``selected`` index rows.

    Rows are range-partitioned by archive and offset; within a task, ranges
    that lie close together become one read.
    """
    folder = _uri(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)

        def fetch(path: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            first = ranges[0][0]
            with fs.open_input_file(f"{root}/{path}") as f:
                data = f.read_at(ranges[-1][0] + ranges[-1][1] - first, first)
            found = [parse(gzip.decompress(data[a - first : a - first + n])) for a, n in ranges]
            return pa.RecordBatch.from_pylist(found, schema=PARSED)

        path, ranges = "", []
        for batch in batches:
            for p, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                far = ranges and (p != path or offset > sum(ranges[-1]) + GAP_BYTES or offset + length - ranges[0][0] > READ_BYTES)
                if far:
                    yield fetch(path, ranges)
                    ranges = []
                path = p
                ranges.append((offset, length))
        if ranges:
            yield fetch(path, ranges)

    places = selected.select("path", "offset", "length")
    ordered = places.repartitionByRange(partitions(selected.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    rows = ordered.mapInArrow(read, PARSED_DDL)
    back = F.when(F.col("refers_to") != NULL_ID, F.col("refers_to"))
    return rows.withColumn("page_id", null_back("page_id")).withColumn("refers_to", back)


def archived(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write to a new folder among the shared ones and return it."""
    folder = _uri(shared_folder(pages.sparkSession, "warc"))
    write_archives(pages, folder, min_bytes)
    return folder


