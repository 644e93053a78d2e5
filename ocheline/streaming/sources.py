"""Streams of throws and frames, and the plain operators over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ocheline.operators.events import adapter_fields, authorised, route_confidence, to_adapter
from ocheline.sources.outbox import publish
from ocheline.sources.tables import split_lines

LATENESS = "10 minutes"


def stream_throws(spark: SparkSession, path: str, lateness: str = LATENESS) -> DataFrame:
    """Throw events as they arrive, in event time; `stream_rejects` has the other lines."""
    good, _ = split_lines(spark.readStream.text(path))
    return good.withWatermark("captured_at", lateness)


def stream_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no throw event, for a sink of their own."""
    _, bad = split_lines(spark.readStream.text(path))
    return bad


def sampled_frames(stream: DataFrame, every: str) -> DataFrame:
    """W1 for a stream: the first frame of each session in each interval, once it is over."""
    first = F.min_by(F.struct("captured_at", "frame_no"), F.struct("captured_at", "frame_no"))
    return (
        stream.groupBy("session_id", F.window("captured_at", every).alias("w"))
        .agg(first.alias("f"))
        .select("session_id", F.col("w.start").alias("slot_start"), "f.captured_at", "f.frame_no")
    )


def once_each(stream: DataFrame) -> DataFrame:
    """Redelivered events removed within the lateness of the watermark."""
    return stream.dropDuplicatesWithinWatermark(["id"])


def session_summary(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Throws and points per session, closed after `gap` without a throw."""
    return (
        stream.groupBy("session_id", F.session_window("captured_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("throws"), F.sum("score").alias("points"))
        .select(
            "session_id",
            F.col("w.start").alias("opened_at"),
            F.col("w.end").alias("closed_at"),
            "throws",
            "points",
        )
    )


def live_frame_rate(stream: DataFrame, width: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """T4: frames per second by runtime, in tumbling or sliding windows."""
    window = F.window("captured_at", width, slide) if slide else F.window("captured_at", width)
    counted = stream.groupBy("runtime", window.alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return counted.select(
        "runtime",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "frames",
        (F.col("frames") / seconds).alias("frames_per_second"),
    )


def with_stored_calibration(stream: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Throws or detections with a calibration that is already stored."""
    return stream.join(calibrations.select("calibration_id", "h"), "calibration_id")


def with_arriving_calibration(
    stream: DataFrame, calibrations: DataFrame, within: str = "1 day"
) -> DataFrame:
    """Both sides arrive. The calibration is at most `within` older than the throw.

    Both streams carry a watermark, on `captured_at` and on `validated_at`; with
    the bound it lets Spark drop state that can no longer match.
    """
    side = calibrations.select(
        F.col("calibration_id").alias("_calibration"), "validated_at", "h"
    )
    match = (
        (F.col("calibration_id") == F.col("_calibration"))
        & (F.col("validated_at") <= F.col("captured_at"))
        & (F.col("captured_at") <= F.col("validated_at") + F.expr(f"INTERVAL {within}"))
    )
    return stream.join(side, match).drop("_calibration")


def store_throws(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """S6 for a stream: the file sink commits each batch once."""
    return (
        stream.withColumn("capture_date", F.to_date("captured_at"))
        .writeStream.format("parquet")
        .partitionBy("capture_date")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def forward_live(
    stream: DataFrame,
    adapter: str,
    mapping: DataFrame | Sequence[tuple[str, str]],
    grants: DataFrame,
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Granted events to the outbox of an adapter; a repeated batch adds nothing."""

    fields = adapter_fields(mapping, adapter)

    def deliver(batch: DataFrame, _: int) -> None:
        allowed = authorised(batch, grants, adapter)
        publish(to_adapter(allowed, fields, adapter, keep=["captured_at"]), path)

    return (
        stream.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def review_queue(
    stream: DataFrame, threshold: float, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Accepted and doubtful throws into a folder each, in one commit."""
    return (
        route_confidence(stream, threshold)
        .writeStream.format("parquet")
        .partitionBy("route")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
