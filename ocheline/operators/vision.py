"""Calibrations, frames and detections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.functions import homography
from ocheline.plans.ordered import as_of, over_groups, previous, running, total
from ocheline.schemas import LANDMARK_NAMES

# Pixels are divided by this before the fit, to keep the sums near 1.
PIXEL_SCALE = 1000.0
# Smallest eigenvalue of the moment matrix, relative to the largest, that counts.
RANK_TOLERANCE = 1e-12


def visible_frames(
    landmarks: DataFrame, expected: Sequence[str] = LANDMARK_NAMES, frame: str = "calibration_id"
) -> DataFrame:
    """P5: frames in which every expected landmark was found."""
    return (
        landmarks.filter(F.col("name").isin(*expected))
        .groupBy(frame)
        .agg(F.count_distinct("name").alias("n_landmarks"))
        .filter(F.col("n_landmarks") == len(set(expected)))
    )


def usable_frames(
    frames: DataFrame,
    landmarks: DataFrame,
    expected: Sequence[str] = LANDMARK_NAMES,
    keys: Sequence[str] = ("session_id", "frame_no"),
) -> DataFrame:
    """P5: the frames, as they are, in which every expected landmark was found."""
    found = (
        landmarks.filter(F.col("name").isin(*expected))
        .groupBy(*keys)
        .agg(F.count_distinct("name").alias("_n"))
        .filter(F.col("_n") == len(set(expected)))
    )
    return frames.join(found.select(*keys), list(keys), "left_semi")


def _moments() -> list[Column]:
    """Sums over landmarks that make up the least-squares system."""
    one = F.lit(1.0)
    u, v = F.col("px") / F.lit(PIXEL_SCALE), F.col("py") / F.lit(PIXEL_SCALE)
    bx, by = F.col("bx"), F.col("by0")
    products = {"one": one, "u": u, "v": v, "uu": u * u, "uv": u * v, "vv": v * v}
    weights = {"p": one, "x": bx, "y": by, "q": bx * bx + by * by}
    return [
        F.sum(product * weight).alias(f"{w}_{p}")
        for w, weight in weights.items()
        for p, product in products.items()
    ]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Solve the 8x8 systems of a batch of calibrations at once."""
    for rows in batches:
        def block(weight: str) -> np.ndarray:
            s = {p: rows[f"{weight}_{p}"].to_numpy() for p in ("one", "u", "v", "uu", "uv", "vv")}
            return np.stack(
                [
                    np.stack([s["uu"], s["uv"], s["u"]], -1),
                    np.stack([s["uv"], s["vv"], s["v"]], -1),
                    np.stack([s["u"], s["v"], s["one"]], -1),
                ],
                -2,
            )

        p, x, y, q = (block(w) for w in "pxyq")
        left = np.zeros((len(rows), 8, 8))
        left[:, 0:3, 0:3] = left[:, 3:6, 3:6] = p
        left[:, 0:3, 6:8] = -x[:, :, 0:2]
        left[:, 3:6, 6:8] = -y[:, :, 0:2]
        left[:, 6:8, 0:6] = np.swapaxes(left[:, 0:6, 6:8], 1, 2)
        left[:, 6:8, 6:8] = q[:, 0:2, 0:2]
        right = np.concatenate([x[:, :, 2], y[:, :, 2], -q[:, 0:2, 2]], axis=1)

        values = np.linalg.eigvalsh(left)
        rank = (values > RANK_TOLERANCE * values[:, -1:]).sum(axis=1)
        full = rank == 8
        h: list[list[float] | None] = [None] * len(rows)
        if full.any():
            solved = np.linalg.solve(left[full], right[full][:, :, None])[:, :, 0]
            solved[:, [0, 1, 3, 4, 6, 7]] /= PIXEL_SCALE
            for place, coefficients in zip(np.flatnonzero(full), solved):
                h[place] = [*map(float, coefficients), 1.0]
        yield pd.DataFrame(
            {"calibration_id": rows["calibration_id"], "h": h, "rank": rank.astype("int32")}
        )


def fit_homography(landmarks: DataFrame) -> DataFrame:
    """M1: least-squares image-to-board mapping and its rank, per calibration.

    The landmarks only enter through sums, so Spark adds them up before and
    after the shuffle, and Python sees one row of sums per calibration.
    """
    sums = landmarks.groupBy("calibration_id").agg(*_moments())
    return sums.mapInPandas(_solve, "calibration_id string, h array<double>, rank int")


def validate_calibration(
    fitted: DataFrame,
    landmarks: DataFrame,
    expected: Sequence[str] = LANDMARK_NAMES,
    max_rms: float = 0.02,
) -> DataFrame:
    """M2: landmarks complete, rank 8 and reprojection error within the bound."""
    at = homography.projected(F.col("px"), F.col("py"), F.col("h"))
    dx, dy = at["x"] - F.col("bx"), at["y"] - F.col("by0")
    n_expected = len(set(expected))
    checked = (
        landmarks.join(fitted, "calibration_id")
        .groupBy("calibration_id")
        .agg(
            F.count_distinct(F.when(F.col("name").isin(*expected), F.col("name"))).alias(
                "n_landmarks"
            ),
            F.first("rank").alias("rank"),
            F.sqrt(F.avg(dx * dx + dy * dy)).alias("rms"),
        )
    )
    ok = (
        (F.col("n_landmarks") == n_expected)
        & (F.col("rank") == 8)
        & (F.col("rms") <= F.lit(max_rms))
    )
    return checked.withColumn("valid", F.coalesce(ok, F.lit(False)))


def project_to_board(detections: DataFrame) -> DataFrame:
    """M3: add the board point (x, y) of a detection that carries its mapping `h`."""
    at = homography.projected(F.col("px"), F.col("py"), F.col("h"))
    return detections.withColumns({"x": at["x"], "y": at["y"]})


def with_calibration(detections: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Each detection with the mapping of its calibration.

    No strategy is forced: Spark broadcasts the calibrations while they are
    below its size threshold, else shuffles and splits a skewed calibration.
    """
    return detections.join(calibrations.select("calibration_id", "h"), "calibration_id")


def asof_calibration(
    detections: DataFrame, calibrations: DataFrame, tie: str = "throw_id"
) -> DataFrame:
    """The latest calibration of the session validated by the capture time."""
    bare = detections.drop("calibration_id", "h")
    return as_of(
        bare,
        calibrations.filter(F.col("validated_at").isNotNull()),
        ["session_id"],
        "captured_at",
        "validated_at",
        tie,
        ["calibration_id", "h"],
    )


def best_tip(detections: DataFrame) -> DataFrame:
    """G1: the most confident detection of each throw; of equals the earlier frame."""
    rows = [c for c in detections.columns if c != "throw_id"]
    rank = F.struct("confidence", -F.col("frame_no"), -F.col("view"))
    return (
        detections.groupBy("throw_id")
        .agg(F.max_by(F.struct(*rows), rank).alias("best"))
        .select("throw_id", "best.*")
    )


def fuse_views(mapped: DataFrame) -> DataFrame:
    """One impact per throw, the views weighted by confidence."""
    weight = F.sum("confidence")
    return mapped.groupBy("throw_id").agg(
        (F.sum(F.col("confidence") * F.col("x")) / F.nullif(weight, F.lit(0.0))).alias("x"),
        (F.sum(F.col("confidence") * F.col("y")) / F.nullif(weight, F.lit(0.0))).alias("y"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_views"),
    )


def sample_frames(frames: DataFrame, every_ms: int) -> DataFrame:
    """The first frame of each session in each interval of `every_ms`."""
    width = every_ms * 1000
    slot = F.floor(micros(F.col("captured_at")) / F.lit(width))
    first = Window.partitionBy("session_id", "slot").orderBy("captured_at", "frame_no")
    return (
        frames.withColumn("slot", slot)
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def micros(stamp: Column) -> Column:
    """Microseconds since the epoch; a time without zone counts as UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, stamp.cast("timestamp_ntz"))


def detect_throws(frames: DataFrame) -> DataFrame:
    """The throws seen in the frame sequence of each session.

    Every tip more than in the frame before is one throw; the throws of a
    session are numbered. A fall to zero marks a retrieval.
    """
    keys, order = ["session_id"], ["captured_at", "frame_no"]

    def scan(rows: DataFrame) -> DataFrame:
        seen = running(rows, keys, order, {"_before": previous(F.col("n_tips"))})
        before = F.coalesce("_before", F.lit(0))
        seen = seen.withColumns(
            {
                "new_tips": F.greatest(F.col("n_tips") - before, F.lit(0)),
                "retrieved": (F.col("n_tips") == 0) & (before > 0),
            }
        ).drop("_before")
        return running(seen, keys, order, {"throws_so_far": total(F.col("new_tips"))})

    return over_groups(frames, keys, order, scan)


def throw_candidates(frames: DataFrame) -> DataFrame:
    """One row per throw detected in the frames, with its number in the session."""
    seen = detect_throws(frames).filter(F.col("new_tips") > 0)
    first = F.col("throws_so_far") - F.col("new_tips") + 1
    return seen.select(
        "session_id",
        "frame_no",
        "captured_at",
        F.explode(F.sequence(first, F.col("throws_so_far"))).alias("throw_no"),
    )
