"""Framed packets: u32 header length, u32 payload length (big-endian), JSON header, payload.

Reading streams Arrow batches of records. A large file is cut at record starts that
``index_packets`` wrote beside it; without that index it is read whole. Small files share a Spark
partition. Writing is one or more files per task, rolled over at a size limit so that later
scans stay parallel. Paths may be anything pyarrow can open (local, hdfs://, s3://, ...).
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from ..functions.clock import integer_value, message_timestamp, variant_kind
from ..functions.identity import packet_source_id
from ..schemas import PACKET, PACKET_METADATA

FORMAT = "framed_packets"
SUFFIX = ".packets"
INDEX_SUFFIX = ".index"
ROLL_BYTES = 256 * 1024 * 1024
SPLIT_BYTES = 256 * 1024 * 1024
# small files are read together: as many bytes a task as make PACK_TASKS tasks, within these bounds
PACK_BYTES = (4 * 1024 * 1024, 64 * 1024 * 1024)
PACK_TASKS = 64
# bytes read ahead with payloads, and without (a payload is skipped by seeking)
AHEAD_BYTES = {True: 1024 * 1024, False: 64 * 1024}
BATCH_BYTES = 8 * 1024 * 1024
BATCH_ROWS = 4096
LENGTHS = ">II"


def _open(path: str):
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(path)


def _take(stream, size: int) -> bytes | None:
    data = stream.read(size) if size else b""
    return data if len(data) == size else None


def read_records(
    stream, with_payload: bool = True, start: int = 0, stop: int | None = None
) -> Iterator[tuple[str, bytes | None, int, int]]:
    """(header, payload, payload offset, payload size) of complete records that begin in [start, stop).

    A cut-off last record yields nothing. Without payload its bytes are skipped, not read.
    """
    end = stream.size()
    ahead = io.BufferedReader(stream, AHEAD_BYTES[with_payload])
    at = start
    try:
        while stop is None or at < stop:
            ahead.seek(at)
            if (lengths := _take(ahead, struct.calcsize(LENGTHS))) is None:
                return
            header_size, payload_size = struct.unpack(LENGTHS, lengths)
            header = _take(ahead, header_size)
            offset = at + len(lengths) + header_size
            if header is None or offset + payload_size > end:
                return
            payload = _take(ahead, payload_size) if with_payload else None
            at = offset + payload_size
            yield header.decode("utf-8"), payload, offset, payload_size
    finally:
        ahead.detach()  # the stream is the caller's to close


def record_starts(stream, split_bytes: int) -> list[tuple[int, int]]:
    """(offset, record number) of the first record at or after each ``split_bytes``; reads lengths only."""
    starts, at, number, end = [], 0, 0, stream.size()
    while at + struct.calcsize(LENGTHS) <= end:
        if not starts or at - starts[-1][0] >= split_bytes:
            starts.append((at, number))
        stream.seek(at)
        lengths = stream.read(struct.calcsize(LENGTHS))
        at += len(lengths) + sum(struct.unpack(LENGTHS, lengths))
        number += 1
    return starts


def frame_record(metadata: str, payload: bytes | None) -> bytes:
    header, body = metadata.encode("utf-8"), bytes(payload or b"")
    return struct.pack(LENGTHS, len(header), len(body)) + header + body


@dataclass
class CapturePart:
    """Records of one file that begin in [start, stop); the first of them is number ``first``."""

    path: str
    start: int = 0
    first: int = 0
    stop: int | None = None


@dataclass
class CaptureParts(InputPartition):
    parts: list[CapturePart]


def packed(parts: list[tuple[CapturePart, int]], split_bytes: int) -> list[CaptureParts]:
    """Parts with their sizes, small neighbours together."""
    least, most = PACK_BYTES
    limit = min(split_bytes, most, max(least, sum(size for _, size in parts) // PACK_TASKS))
    groups, filled = [], 0
    for part, size in parts:
        if not groups or filled + size > limit:
            groups.append(CaptureParts([]))
            filled = 0
        groups[-1].parts.append(part)
        filled += size
    return groups


def capture_files(path: str) -> list[tuple[str, fs.FileInfo]]:
    """Paths as the caller writes them, with the found files, in order."""
    files, root = _open(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info)]
    base, found = path.rstrip("/"), files.get_file_info(fs.FileSelector(root, recursive=True))
    return [
        (base + f.path.removeprefix(root.rstrip("/")), f)
        for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(SUFFIX)
    ]


def _index(path: str, size: int) -> list[tuple[int, int]]:
    """The record starts beside a file; only its beginning if there are none or they are of a longer file."""
    files, name = _open(path + INDEX_SUFFIX)
    if files.get_file_info(name).type != fs.FileType.File:
        return [(0, 0)]
    with files.open_input_stream(name) as stream:
        index = json.loads(stream.read())
    return [tuple(x) for x in index["starts"]] if index["size"] <= size else [(0, 0)]


class PacketReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, split_bytes: int):
        self.path = path
        self.with_payload = with_payload
        self.split_bytes = split_bytes

    def partitions(self):
        found = capture_files(self.path)
        large = [(path, f.size) for path, f in found if f.size > self.split_bytes]
        with ThreadPoolExecutor(32) as pool:
            indexes = dict(zip((p for p, _ in large), pool.map(lambda x: _index(*x), large)))
        parts = []
        for path, info in found:
            cuts = []
            for offset, number in indexes.get(path, [(0, 0)]):
                if not cuts or offset - cuts[-1][0] >= self.split_bytes:
                    cuts.append((offset, number))
            stops = [offset for offset, _ in cuts[1:]] + [None]
            parts += [
                (CapturePart(path, *cut, stop), (stop or info.size) - cut[0]) for cut, stop in zip(cuts, stops)
            ]
        return packed(parts, self.split_bytes)

    def read(self, partition):
        schema, rows, size = to_arrow_schema(PACKET), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for part in partition.parts:
            files, path = _open(part.path)
            with files.open_input_file(path) as stream:
                records = read_records(stream, self.with_payload, part.start, part.stop)
                for seq, record in enumerate(records, part.first):
                    rows.append((part.path, seq, *record))
                    size += len(record[0]) + len(record[1] or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    staged: list[str]


class PacketWriter(DataSourceArrowWriter):
    """Files become visible under their final name only when the whole job commits."""

    def __init__(self, path: str, roll_bytes: int):
        self.path = path
        self.roll_bytes = roll_bytes

    def write(self, iterator):
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        staged, stream, size = [], None, 0
        try:
            for batch in iterator:
                for metadata, payload in zip(batch.column("metadata"), batch.column("payload")):
                    if stream is None:
                        staged.append(f"{root.rstrip('/')}/part-{uuid.uuid4().hex}{SUFFIX}.staged")
                        stream, size = files.open_output_stream(staged[-1], buffer_size=1024 * 1024), 0
                    record = frame_record(metadata.as_py(), payload.as_py())
                    stream.write(record)
                    size += len(record)
                    if size >= self.roll_bytes:
                        stream.close()
                        stream = None
            if stream is not None:
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            for name in staged:
                files.delete_file(name)
            raise
        return Written(staged)

    def commit(self, messages):
        files, _ = _open(self.path)
        for message in messages:
            for name in message.staged if message else []:
                files.move(name, name.removesuffix(".staged"))

    def abort(self, messages):
        files, _ = _open(self.path)
        for message in messages:
            for name in message.staged if message else []:
                files.delete_file(name)


class FramedPackets(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return PACKET

    def reader(self, schema):
        split_bytes = int(self.options.get("split_bytes", SPLIT_BYTES))
        return PacketReader(self.options["path"], self.options.get("payload", "true") == "true", split_bytes)

    def writer(self, schema, overwrite):
        return PacketWriter(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedPackets)


def index_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> int:
    """Write record starts beside every capture file above ``split_bytes``; returns how many files.

    One task per file reads the lengths of its records. Later records of a growing file fall to
    its last part; a file that was replaced must be indexed again.
    """
    large = [(name,) for name, f in capture_files(path) if f.size > split_bytes]
    if not large:
        return 0

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                files, inner = _open(name)
                with files.open_input_file(inner) as stream:
                    index = {"size": stream.size(), "starts": record_starts(stream, split_bytes)}
                staged = f"{inner}{INDEX_SUFFIX}-{uuid.uuid4().hex}"
                with files.open_output_stream(staged) as out:
                    out.write(json.dumps(index).encode())
                files.move(staged, inner + INDEX_SUFFIX)
            yield batch

    names = spark.createDataFrame(large, "path string").repartition(len(large))
    return names.mapInPandas(write, "path string").count()


def read_packets(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, seq, metadata JSON, payload, offset, n_bytes) of all capture files under ``path``.

    With ``payload=False`` only headers are read and payload is NULL: filter and join
    those small rows, then load what is left with ``load_payload``.
    """
    register(spark)
    options = {"payload": str(payload).lower(), "split_bytes": split_bytes}
    return spark.read.format(FORMAT).options(**options).load(path)


@F.pandas_udf(T.BinaryType())
def load_payload(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Payload bytes from (path, offset, n_bytes); no shuffle carries them."""
    for paths, offsets, sizes in batches:
        out = pd.Series([None] * len(paths), dtype=object)
        places = pd.DataFrame({"path": paths, "offset": offsets, "size": sizes}).reset_index(drop=True)
        for path, part in places.sort_values(["path", "offset"]).groupby("path", sort=False):
            files, name = _open(path)
            with files.open_input_file(name) as stream:
                for at, offset, size in zip(part.index, part["offset"], part["size"]):
                    out[at] = stream.read_at(int(size), int(offset)) if size else b""
        yield out


def write_packets(packets: DataFrame, path: str, roll_bytes: int = ROLL_BYTES) -> None:
    """Write rows with ``metadata`` (JSON text) and ``payload`` as framed files."""
    register(packets.sparkSession)
    packets.select("metadata", "payload").write.format(FORMAT).mode("append").option(
        "roll_bytes", roll_bytes
    ).save(path)


def parse_metadata(packets: DataFrame, ingest: str | None = None) -> DataFrame:
    """Packets with typed metadata; absent keys take the consumer's defaults.

    Integers keep their JSON type: 1.5 and true are numbers, the text "1.5" is not; times take
    no number with a fraction."""
    keys = ("frame", "data_source_id", "source_timestamp_ns", "timestamp_ns")
    parsed = packets.withColumns({"_m": F.from_json("metadata", PACKET_METADATA), "_v": F.try_parse_json("metadata")})
    # in steps, so that no expression is repeated inside others
    parsed = parsed.withColumns({f"_kind_{k}": variant_kind("_v", k) for k in keys})
    parsed = parsed.withColumns({
        f"_{k}": integer_value("_v", k, f"_kind_{k}", fractions=not k.endswith("_ns")) for k in keys
    })
    stamped_at = message_timestamp(F.col("_source_timestamp_ns"), F.col("_timestamp_ns"), ingest)
    kept = [c for c in packets.columns if c != "metadata"]
    return parsed.select(
        *kept,
        F.col("_m.stage").alias("stage"),
        F.col("_frame").alias("frame"),
        stamped_at.alias("message_ts_ns"),
        "_m.timestamp", "_m.timestamp_source",
        packet_source_id("_data_source_id", "_kind_data_source_id", "_frame").alias("data_source_id"),
        F.coalesce("_m.format", F.lit("jpeg")).alias("format"),
        F.coalesce("_m.log_text", F.lit("metadata=missing")).alias("log_text"),
        F.coalesce("_m.objects", F.array().cast(PACKET_METADATA["objects"].dataType)).alias("objects"),
        F.col("_m.bytes").alias("bytes"),
    )
