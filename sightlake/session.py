"""Session settings and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sightlake

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # row_number() <= k is cut to k rows per group before the shuffle, also for stores of 4096 entries
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # a frame-keyed shuffle also serves joins on (stream, frame)
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}
_STATE_STORE = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)
_local_dirs: dict[str, str] = {}


def build(app: str = "sightlake", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    # Python workers get the package's functions with the task, installed there or not
    cloudpickle.register_pickle_by_value(sightlake)
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
