"""Running streams to tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a Parquet table, exactly once, then stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )


def start_fork(
    stream: DataFrame, branches: Mapping[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str
) -> StreamingQuery:
    """Fan one stream out to a table per branch.

    Each micro-batch is kept while its branches are written. A branch's rows of a
    batch go to a folder of their own that a retry overwrites, so a repeated batch
    leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, build in branches.items():
                build(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
