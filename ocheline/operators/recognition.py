"""From frames to throw events: the steps of recognition as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocheline.operators import board, events, vision


def tips_of_throws(candidates: DataFrame, detections: DataFrame) -> DataFrame:
    """Give each throw seen in a frame one of the frame's tips, the most confident first.

    `candidates` are (session_id, frame_no, captured_at, throw_no). The throws
    of a frame take its tips in order of confidence, of equals the lower view;
    a throw without a tip left, and a tip without a throw, drop out.
    """
    frame = ["session_id", "frame_no"]
    within = Window.partitionBy(*frame)
    throws = candidates.withColumn("_n", F.row_number().over(within.orderBy("throw_no")))
    tips = detections.drop("captured_at").withColumn(
        "_n", F.row_number().over(within.orderBy(F.col("confidence").desc(), "view"))
    )
    return throws.join(tips, [*frame, "_n"]).drop("_n")


def throws_from_frames(frames: DataFrame, detections: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Frames, the tips found in them and calibrations as throw events.

    Throws are told from the number of tips (W2), get a tip each, are mapped to
    the board by its calibration (J1, M3, M4) and become events (P6). Everything
    up to the join with the calibrations is keyed by the session and frame.
    """
    tips = tips_of_throws(vision.throw_candidates(frames), detections)
    mapped = board.map_segment(vision.project_to_board(vision.with_calibration(tips, calibrations)))
    identity = ("session_id", "frame_no", "calibration_id", "throw_no")
    return events.assemble_throws(mapped, identity)
