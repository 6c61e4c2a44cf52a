"""Stage marks, latencies and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import FRAME_KEYS, STAGES
from ..functions.clock import rate_from_ms, rate_from_seconds
from ..skew import bucketed_row_number
from .sampling import interval_sample


def pivot_stages(
    marks: DataFrame, keys: Sequence[str] = FRAME_KEYS, stages: Sequence[str] = STAGES
) -> DataFrame:
    """One row per frame with a column per stage; the latest mark of a stage counts."""
    return marks.groupBy(*keys).agg(*[
        F.max_by("t_us", F.when(F.col("stage") == s, F.col("arrival_seq"))).alias(s) for s in stages
    ])


def stage_latency(wide: DataFrame, start="mux", detected="infer", assessed="assessment") -> DataFrame:
    """detect_ms and assess_ms, never negative; NULL where a mark is missing."""
    def ms(later: str, earlier: str):
        elapsed = (F.col(later) - F.col(earlier)) / F.lit(1000.0)
        # greatest() skips NULL, so the guard comes first
        return F.when(elapsed.isNotNull(), F.greatest(F.lit(0.0), elapsed))

    timed = wide.withColumn("detect_ms", ms(detected, start)).withColumn("assess_ms", ms(assessed, detected))
    return timed.withColumn("detect_fps", rate_from_ms("detect_ms")).withColumn(
        "assess_fps", rate_from_ms("assess_ms")
    )


def stage_durations(wide: DataFrame) -> DataFrame:
    """Microseconds per stage of complete frames; frames without assessment take the short path."""
    c = F.col
    complete = c("mux").isNotNull() & c("infer").isNotNull() & c("convert").isNotNull()
    complete = complete & c("osd").isNotNull() & c("sink").isNotNull()
    return wide.filter(complete).select(
        "*",
        (c("infer") - c("mux")).alias("detect_us"),
        (c("assessment") - c("infer")).alias("assess_us"),
        (c("convert") - F.coalesce(c("assessment"), c("infer"))).alias("convert_us"),
        (c("osd") - c("convert")).alias("osd_us"),
        (c("sink") - c("osd")).alias("sink_us"),
        (c("sink") - c("mux")).alias("total_us"),
    )


def stage_averages(
    wide: DataFrame, by: Sequence[str] = ("stream_id",), seconds: int = 10
) -> DataFrame:
    """Averages of complete frames per window of the sink time; 0 where no frame has the stage.

    assess_ms and assess_fps are NULL in windows where no frame was assessed.
    """
    width = seconds * 1_000_000
    opened = (F.col("sink") - F.pmod(F.col("sink"), F.lit(width))).alias("window_us")
    names = ("detect", "assess", "convert", "osd", "sink", "total")
    means = stage_durations(wide).groupBy(*by, opened).agg(
        F.count("*").alias("n"), *[F.avg(f"{s}_us").alias(f"_{s}") for s in names]
    )

    def mean(stage):
        return F.coalesce(F.col(f"_{stage}"), F.lit(0.0))

    assessed = F.col("_assess").isNotNull()
    return means.select(
        *by, "window_us", "n",
        (mean("detect") / 1000.0).alias("detect_ms"),
        rate_from_seconds(mean("detect") / 1e6).alias("detect_fps"),
        F.when(assessed, F.col("_assess") / 1000.0).alias("assess_ms"),
        F.when(assessed, rate_from_seconds(F.col("_assess") / 1e6)).alias("assess_fps"),
        *[(mean(s) / 1000.0).alias(f"{s}_ms") for s in ("convert", "osd", "sink", "total")],
    )


def output_fps(
    frames: DataFrame, time_us: str, by: Sequence[str] = ("stream_id",), seconds: int = 1
) -> DataFrame:
    """Frames per second on a regular grid."""
    width = seconds * 1_000_000
    opened = F.col(time_us) - F.pmod(F.col(time_us), F.lit(width))
    return frames.groupBy(*by, opened.alias("window_us")).agg(
        F.count("*").alias("frames"), (F.count("*") / F.lit(float(seconds))).alias("fps")
    )


def reported_fps(
    frames: DataFrame, interval_us: int = 1_000_000, time: str = "ts_us", by: Sequence[str] = ("stream_id",),
    arrival: str = "arrival_seq",
) -> DataFrame:
    """Rate reports as a live counter makes them: one at the first frame at least an interval
    after the last report, over the frames and the time since then. Counting starts with
    the stream's first frame, which makes no report.
    """
    counted = bucketed_row_number(frames.select(*by, arrival, time), by, arrival, "_n")
    # only reports, at most one per interval, meet in the per-stream window
    order = W.partitionBy(*by).orderBy(time)
    reports = interval_sample(counted, interval_us, by, time, arrival).withColumns({
        "_since": F.lag(time).over(order),
        "_seen": F.when(F.row_number().over(order) == 2, F.lit(0)).otherwise(F.lag("_n").over(order)),
    }).filter(F.col("_since").isNotNull())
    return reports.select(
        *by, F.col(time), (F.col("_n") - F.col("_seen")).alias("frames"),
        ((F.col("_n") - F.col("_seen")) / ((F.col(time) - F.col("_since")) / F.lit(1e6))).alias("fps"),
    )
