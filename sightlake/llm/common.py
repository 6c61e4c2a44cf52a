"""Helpers shared by the operators: session limits, vocabulary files, worker state, shared files."""

import os
import pickle
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
import pyspark.cloudpickle as cloudpickle
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import sightlake

# Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
# Rows of at most 64 bytes that may travel as a broadcast.
BROADCAST_ROWS = 500_000


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and ship this package's functions with the task."""
    cloudpickle.register_pickle_by_value(sightlake)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """An absolute path as it is; any other name among the installed public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_state(key, make: Callable):
    """``make()`` once per Python process. Functions are shipped by value, so module globals
    do not outlive a task; vocabularies and word caches are kept beside them instead."""
    kept = sys.modules.setdefault("_sightlake_worker_state", types.ModuleType("_sightlake_worker_state"))
    found = kept.__dict__.setdefault("entries", {})
    if key not in found:
        found[key] = make()
    return found[key]


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object of this package with its class, for workers that do not have the package."""
    return tuned(spark).sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(shared: Broadcast):
    return pickle.loads(shared.value)


class WordCache(dict):
    """Bounded memo for short keys: the older half goes when full, long keys never stay."""

    def __init__(self, entries: int = 300_000, longest: int = 64):
        super().__init__()
        self.entries, self.longest = entries, longest

    def trim(self) -> None:
        if len(self) > self.entries:
            for key in list(islice(self, len(self) - self.entries // 2)):
                del self[key]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def windows(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The whole text in pieces of about ``size`` characters, each later one starting at a single
    space between two non-space characters; one piece if there is no such place."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def text_of(column: str) -> Column:
    """NULL texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str) -> Column:
    """crc32 of the id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def plain_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(uri)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
