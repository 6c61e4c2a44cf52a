"""Token ids in files with random access to any token: directly addressable codes.

Method: an id is cut into chunks of ``BITS`` bits. Level 0 holds the lowest chunk of every id;
a bitmap per level says which ids go on, and the next level holds a chunk of only those. A rank
directory (ones before every 512 bits) turns a position of one level into its position in the
next, so any id is found with a few small reads and no block is decoded.

File layout (little-endian): magic "DACIDS01", then a footer's worth of sections, each found by
the footer: per level the chunk bytes, the continuation bitmap (bit i & 7 of byte i >> 3) and
the directory (uint64 per 512 bits); the document table (int64 doc_id, a validity byte, int64
first id) ; the footer (JSON) and its length (uint32) with the magic again.

Files are written by range-partitioned tasks in ascending doc_id order (NULL ids first, repeated
ids by text) into the shared folder, each with at most ``file_ids`` ids unless one document alone
has more. Names carry a random part: a file counts only once its task's row is in the manifest,
so lost executors and repeated tasks leave no trace in the results.

Defined results: NULL text counts as empty; every document ends with ``end_id``; special strings
are handled as the tokenizer does by default; an empty table gives an empty manifest.
"""

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sightlake.session import materialize, new_path

from .cached_ids import ByteLevelIds as CachedEncoder
from .common import batch_of, open_store, text_of, vocabulary_path, worker_state

MAGIC = b"DACIDS01"
BITS = 8
BLOCK = 512  # bits of a bitmap per directory entry
FILE_IDS = 1 << 24
READ_IDS = 1 << 20


class ChunkLevels:
    """Collects ids level by level and gives the sections of a file."""

    def __init__(self):
        self.chunks: list[bytearray] = []
        self.flags: list[list[np.ndarray]] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        level, rest = 0, ids.astype(np.uint32)
        while len(rest):
            if level == len(self.chunks):
                self.chunks.append(bytearray())
                self.flags.append([])
            self.chunks[level] += (rest & 255).astype(np.uint8).tobytes()
            more = rest >= 256
            self.flags[level].append(more)
            rest = rest[more] >> BITS
            level += 1

    def write(self, out) -> None:
        sections, at = {}, 0

        def put(name: str, data: bytes) -> None:
            nonlocal at
            out.write(data)
            sections[name] = [at, len(data)]
            at += len(data)

        put("magic", MAGIC)
        for level, chunk in enumerate(self.chunks):
            flags = np.concatenate(self.flags[level])
            self.flags[level] = [flags]
            put(f"chunks{level}", bytes(chunk))
            put(f"bitmap{level}", np.packbits(flags, bitorder="little").tobytes())
            ones = np.add.reduceat(flags, np.arange(0, len(flags), BLOCK), dtype=np.uint64)
            put(f"ranks{level}", np.r_[np.uint64(0), np.cumsum(ones)].astype("<u8").tobytes())
        put("docs", np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        put("valid", np.array([d is not None for d in self.doc_ids], np.uint8).tobytes())
        put("starts", np.array(self.starts, "<i8").tobytes())
        footer = json.dumps({"n": self.n, "levels": len(self.chunks), "sections": sections}).encode()
        out.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class TokenFile:
    """Random access to a file of ids: ``f[i]`` one id, ``f.ids(a, b)`` a run of them."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.source = store.open_input_file(path)
        size = self.source.size()
        length, magic = struct.unpack("<I8s", self.source.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        footer = json.loads(self.source.read_at(length, size - 12 - length))
        self.n, self.levels, self.sections = footer["n"], footer["levels"], footer["sections"]

    def close(self) -> None:
        self.source.close()

    def _read(self, name: str, start: int, length: int) -> bytes:
        at, size = self.sections[name]
        if start < 0 or start + length > size:
            raise IndexError(name)
        return self.source.read_at(length, at + start)

    def _rank(self, level: int, position: int) -> int:
        """Ones before ``position`` in a level's bitmap."""
        block = position // BLOCK
        ones = int.from_bytes(self._read(f"ranks{level}", 8 * block, 8), "little")
        first = block * BLOCK
        if position > first:
            length = (position + 7) // 8 - first // 8
            bits = np.unpackbits(np.frombuffer(self._read(f"bitmap{level}", first // 8, length), np.uint8), bitorder="little")
            ones += int(bits[: position - first].sum())
        return ones

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1; reads only their chunks, bits and one directory entry per level."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        out = np.zeros(stop - start, np.uint32)
        where, level, shift = np.arange(stop - start), 0, 0
        while len(where):
            n = len(where)
            out[where] |= np.frombuffer(self._read(f"chunks{level}", start, n), np.uint8).astype(np.uint32) << np.uint32(shift)
            first = start // 8
            bits = np.unpackbits(
                np.frombuffer(self._read(f"bitmap{level}", first, (start + n + 7) // 8 - first), np.uint8), bitorder="little"
            )[start - 8 * first :][:n].astype(bool)
            if not bits.any():
                break
            start = self._rank(level, start)
            where, level, shift = where[bits], level + 1, shift + BITS
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])

    def __len__(self) -> int:
        return self.n

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids in file order and the first id of each, with the end appended."""
        column = lambda name, kind: np.frombuffer(self._read(name, 0, self.sections[name][1]), kind)
        ids, valid = column("docs", "<i8").tolist(), column("valid", np.uint8).tolist()
        return [d if v else None for d, v in zip(ids, valid)], np.r_[column("starts", "<i8"), self.n]


MANIFEST = "shard int, seq int, path string, n_docs long, n_ids long"


def write_token_files(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, file_ids: int = FILE_IDS,
    doc_id: str = "doc_id", text: str = "text", folder: str | None = None,
) -> DataFrame:
    """Write all ids in ascending doc_id order; the manifest: shard, seq, path, n_docs, n_ids."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("token_files", tokenizer), lambda: CachedEncoder(vocabulary_path(tokenizer)))
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        shard, done, levels = TaskContext.get().partitionId(), [], ChunkLevels()

        def close() -> None:
            name = f"ids-{shard:06d}-{len(done):04d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                levels.write(out)
            done.append((f"{folder}/{name}", len(levels.doc_ids), levels.n))

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, packed in zip(ids, encoder.encode(batch.column(1).to_pylist())):
                levels.add(doc, np.frombuffer(packed + end, "<u4"))
                if levels.n >= file_ids:
                    close()
                    levels = ChunkLevels()
        if levels.n:
            close()
        if done:
            paths, n_docs, n_ids = zip(*done)
            yield batch_of(schema, [[shard] * len(done), range(len(done)), paths, n_docs, n_ids])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    # the start of the text spreads rows of one id, or of none, in the same order
    ordered = slim.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens (with the end id), ids (packed)."""
    # one row per file: the running total over files is small whatever the documents' number
    before = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n_files = max(1, manifest.count())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = TokenFile(row["path"])
                docs, starts = source.documents()
                i = 0
                while i < len(docs):  # runs of documents of about READ_IDS ids at a time
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + READ_IDS, side="right")) - 1)
                    ids = source.ids(int(starts[i]), int(starts[j])).astype("<u4")
                    cut = starts[i : j + 1] - starts[i]
                    for k in range(i, j, 500):
                        to = min(k + 500, j)
                        yield batch_of(schema, [
                            docs[k:to], starts[k:to] + row["start"], np.diff(starts[k : to + 1]),
                            [ids[cut[d - i] : cut[d - i + 1]].tobytes() for d in range(k, to)],
                        ])
                    i = j
                source.close()

    spread = files.repartitionByRange(n_files, "shard", "seq")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def stored_documents(docs: DataFrame) -> DataFrame:
    """Write ``docs`` as token files, read them back, and report each document."""
    found = read_token_files(write_token_files(docs))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
