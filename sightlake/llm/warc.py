"""WARC archives written and read by Spark tasks, index first.

Method: every task writes gzip members (one per record) to files of its own and returns one
index row per record: file, offset, length, URL, digest. Readers select index rows, sort them by
file and offset, coalesce neighbouring byte ranges and read each range once.

Which records are revisits is decided before writing, from digests alone: per payload the record
with the largest page id is the response. Payloads are shuffled once, with that decision; a
payload shared by very many pages is a skewed join key, which adaptive execution splits.

Files count only once their task's rows are in the index (names carry a random part), so
repeated tasks leave nothing behind in the results.

Defined results: NULL html counts as empty, a NULL url as an empty one; of equal payloads all rows
with the largest page id are responses (repeated rows of one page), the others revisits of it; a
NULL page id is a response only if no page id is known. Payloads shorter than ``min_bytes`` are
always responses.
"""

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sightlake.session import materialize, new_path

from .common import batch_of, open_store

FILE_BYTES = 1 << 30
GAP_BYTES = 64 << 10  # unselected bytes worth reading to save a request
RANGE_BYTES = 8 << 20  # longest coalesced read, unless one record is longer
TASK_BYTES = 16 << 20  # compressed bytes read by one task
DATE = "2000-01-01T00:00:00Z"

INDEX = [
    ("file", pa.string(), "string"), ("offset", pa.int64(), "long"), ("length", pa.int64(), "long"),
    ("url", pa.string(), "string"), ("digest", pa.string(), "string"), ("page_id", pa.int64(), "long"),
    ("record_type", pa.string(), "string"),
]
RECORD = [
    ("page_id", pa.int64(), "long"), ("url", pa.string(), "string"), ("record_type", pa.string(), "string"),
    ("refers_to", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_digest", pa.string(), "string"),
    ("payload", pa.binary(), "binary"),
]


def _arrow(fields) -> pa.Schema:
    return pa.schema([(name, kind) for name, kind, _ in fields])


def _ddl(fields) -> str:
    return ", ".join(f"`{name}` {kind}" for name, _, kind in fields)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    text = identifier.strip("<>").removeprefix("urn:page:")
    return None if text == "none" else int(text)


def encode_record(page_id, url: str, kind: str, refers_to, payload: bytes | None, size: int, digest: str) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP header with the full
    payload's length and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode().split("\r\n") if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def decode_record(member: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, kind, stated = int(_headers(http)["content-length"]), warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != stated or len(payload) != size:
            raise ValueError(f"{warc['warc-record-id']}: payload does not match its digest")
    refers = warc.get("warc-refers-to")
    return (
        page_of(warc["warc-record-id"]), warc["warc-target-uri"], kind, None if refers is None else page_of(refers),
        size, stated, payload if kind == "response" else None,
    )


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with payload, sha and the response's page id of their payload (``keeper``)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    keepers = rows.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("sha", "keeper")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(keepers, "sha", "left").select(
        "page_id", "url", "payload", F.coalesce(revisit, F.lit(False)).alias("revisit"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page; the index, one row per record."""
    folder = folder or new_path(pages.sparkSession, "warc")
    schema = _arrow(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task, number, out, at, name = TaskContext.get().partitionId(), 0, None, 0, ""
        for batch in batches:
            rows = []
            for page, url, payload, again, refers in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    name = f"pages-{task:06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                    info = b"software: sightlake\r\nformat: WARC File Format 1.1\r\n"
                    at += out.write(gzip.compress(
                        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\n"
                        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
                        + info + b"\r\n\r\n", mtime=0))
                kind = "revisit" if again else "response"
                url = url.replace("\r", "%0D").replace("\n", "%0A")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                member = encode_record(page, url, kind, refers, payload, len(payload), digest)
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), url, digest, page, kind))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            if rows:
                yield batch_of(schema, list(zip(*rows)))
        if out is not None:
            out.close()

    return materialize(plan_records(pages, min_bytes).mapInArrow(write, _ddl(INDEX)), "warc-index")


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, longest: int = RANGE_BYTES) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in runs that are read at once."""
    runs: list[list[tuple[int, int]]] = []
    for offset, length in ranges:
        if runs:
            first, (last, size) = runs[-1][0][0], runs[-1][-1]
            if offset - (last + size) <= gap and offset + length - first <= longest:
                runs[-1].append((offset, length))
                continue
        runs.append([(offset, length)])
    return runs


def read_warc(selected: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the selected index rows: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (NULL for revisits)."""
    schema = _arrow(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            files, ranges = batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            start = 0
            while start < len(files):
                stop = start
                while stop < len(files) and files[stop] == files[start]:
                    stop += 1
                if files[start] != name:
                    if source is not None:
                        source.close()
                    name = files[start]
                    store, path = open_store(name)
                    source = store.open_input_file(path)
                for run in coalesced(ranges[start:stop]):
                    first, (last, size) = run[0][0], run[-1]
                    data = source.read_at(last + size - first, first)
                    yield batch_of(schema, list(zip(*(decode_record(data[o - first : o - first + n]) for o, n in run))))
                start = stop
        if source is not None:
            source.close()

    # tasks by the bytes to be read, not by the index's own size
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    sorted_ = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(read, _ddl(RECORD))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages and report what their records say when read back."""
    return read_warc(write_warc(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
