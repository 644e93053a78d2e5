"""Reports on accuracy, confidence, corrections, calibration and runtime.

Each report first counts at the finest grain it needs, before anything is
shuffled or expanded; subtotals and quantiles are taken from those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocheline.operators.vision import micros


def accuracy_report(pairs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Agreement by lighting, board and dart, with subtotals.

    Pairs are counted per session before the join, and per condition before the
    rollup, so neither sees the single throws. Sessions of unknown conditions
    are lines with null conditions, told from subtotals by `level`.
    """
    per_session = pairs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("n_agree")
    )
    dims = ["lighting", "board", "dart"]
    finest = (
        per_session.join(conditions, "session_id", "left")
        .groupBy(*dims)
        .agg(F.sum("n").alias("n"), F.sum("n_agree").alias("n_agree"))
    )
    return (
        finest.rollup(*dims)
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.sum("n").alias("throws"),
            F.sum("n_agree").alias("agreeing"),
        )
        .withColumn("accuracy", F.col("agreeing") / F.col("throws"))
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Detected against corrected segment, counted."""
    return pairs.groupBy("detected_segment", "corrected_segment").agg(
        F.count(F.lit(1)).alias("throws")
    )


def confusion_matrix(pairs: DataFrame, segments: Sequence[int]) -> DataFrame:
    """G5 as a matrix with one column per corrected segment."""
    return (
        confusion(pairs)
        .groupBy("detected_segment")
        .pivot("corrected_segment", list(segments))
        .agg(F.sum("throws"))
        .na.fill(0)
    )


def _counted(value: Column, resolution: float | None) -> Column:
    """The value itself, or rounded to a multiple of `resolution`."""
    if resolution is None:
        return value
    return F.round(value / F.lit(resolution)) * F.lit(resolution)


def impact_error(
    pairs: DataFrame,
    by: Sequence[str] = (),
    corrected_only: bool = True,
    resolution: float | None = None,
) -> DataFrame:
    """Median and 95th percentile of the distance between detected and corrected.

    With `corrected_only` pairs whose detection stands are left out. Distances
    are counted before the percentiles are taken. These are exact and hold one
    entry for each different distance; a `resolution` in board radii bounds
    that number and makes them approximate. `largest` is exact either way.
    """
    if corrected_only:
        pairs = pairs.filter(F.col("final_id") != F.col("id"))
    distance = F.hypot(
        F.col("detected_x") - F.col("corrected_x"), F.col("detected_y") - F.col("corrected_y")
    )
    counted = pairs.groupBy(*by, _counted(distance, resolution).alias("_d")).agg(
        F.count(F.lit(1)).alias("n"), F.max(distance).alias("top")
    )
    return counted.groupBy(*by).agg(
        F.sum("n").alias("throws"),
        F.percentile("_d", F.lit(0.5), F.col("n")).alias("p50"),
        F.percentile("_d", F.lit(0.95), F.col("n")).alias("p95"),
        F.max("top").alias("largest"),
    )


# Size of a quantile sketch: a share that is read from it is off by less than
# SKETCH_ERROR with a probability of 0.99, whatever was merged.
SKETCH_K = 1000
SKETCH_ERROR = 0.003


def _sketched(rows: DataFrame, value: Column, by: Sequence[Column]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.max(value).alias("largest"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"),
    )


def _quantile(p: float) -> Column:
    merged = F.kll_merge_agg_double("sketch", F.lit(SKETCH_K))
    return F.when(F.sum("n") > 0, F.kll_sketch_get_quantile_double(merged, F.lit(p)))


def impact_error_sketches(
    pairs: DataFrame, by: Sequence[str] = (), corrected_only: bool = True
) -> DataFrame:
    """G6 by day, to be stored: (by…, day, n, largest, sketch), a row of bounded size each.

    Days that arrive later are appended; several rows of one day add up.
    """
    if corrected_only:
        pairs = pairs.filter(F.col("final_id") != F.col("id"))
    distance = F.hypot(
        F.col("detected_x") - F.col("corrected_x"), F.col("detected_y") - F.col("corrected_y")
    )
    return _sketched(pairs, distance, [*map(F.col, by), F.to_date("captured_at").alias("day")])


def impact_error_merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G6 from stored sketches, whatever days are left in them: `impact_error` within SKETCH_ERROR.

    A quantile is one of the values; the share of values up to it is the asked
    one within that error. Counts and `largest` are exact.
    """
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("throws"),
        _quantile(0.5).alias("p50"),
        _quantile(0.95).alias("p95"),
        F.max("largest").alias("largest"),
    )


def runtime_sketches(frames: DataFrame, width: str = "1 minute") -> DataFrame:
    """G11 by window, to be stored: (runtime, window_start, frames, n, largest, sketch)."""
    window = F.window("captured_at", width)
    counted = frames.withColumn("window_start", window["start"])
    keys = ["runtime", "window_start"]
    sizes = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count("latency_ms").alias("n"),
        F.max("latency_ms").alias("largest"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"),
    )
    return sizes


def runtime_merged(sketches: DataFrame, width: str) -> DataFrame:
    """G11 over wider windows from stored sketches of narrower ones, within SKETCH_ERROR."""
    window = F.window("window_start", width)
    seconds = (micros(window["end"]) - micros(window["start"])) / F.lit(1e6)
    return (
        sketches.groupBy("runtime", window.alias("w"), seconds.alias("_seconds"))
        .agg(
            F.sum("frames").alias("frames"),
            _quantile(0.5).alias("latency_p50"),
            _quantile(0.95).alias("latency_p95"),
        )
        .select(
            "runtime",
            F.col("w.start").alias("window_start"),
            "frames",
            (F.col("frames") / F.col("_seconds")).alias("frames_per_second"),
            "latency_p50",
            "latency_p95",
        )
    )


def threshold_sweep(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold, how many throws go to review and how many errors pass.

    Each pair is counted once, in the interval between two thresholds; the
    numbers for a threshold are sums over those few intervals.
    """
    levels = sorted({float(t) for t in thresholds})
    # Number of thresholds the confidence reaches: the pair is reviewed at the
    # levels from there on.
    reached = sum(
        (F.when(F.col("confidence") >= F.lit(t), 1).otherwise(0) for t in levels), F.lit(0)
    )
    per_interval = pairs.groupBy(reached.alias("reached")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("agree")).alias("wrong")
    )
    line = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"))
                for i, t in enumerate(levels)
            ]
        )
    )
    review = F.col("reached") <= F.col("l.i")
    return (
        per_interval.withColumn("l", line)
        .groupBy(F.col("l.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(review, F.col("n")).otherwise(0)).alias("in_review"),
            F.sum(F.when(~review, F.col("wrong")).otherwise(0)).alias("missed_errors"),
            F.sum(F.when(review, F.col("wrong")).otherwise(0)).alias("caught_errors"),
        )
    )


def confidence_calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Mean confidence against observed agreement, in equal bins."""
    place = F.least(F.floor(F.col("confidence") * F.lit(float(bins))), F.lit(bins - 1))
    return pairs.groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("throws"),
        F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("agree").cast("double")).alias("agreement"),
    )


def correction_rate(throws: DataFrame) -> DataFrame:
    """Share of corrections per session, per player, per source of the event, and overall.

    `session_id`, `player_id` and `source` are null where the line sums over them.
    """
    finest = throws.groupBy("session_id", "player_id", "source").agg(F.count(F.lit(1)).alias("n"))
    sums = finest.groupingSets(
        [[F.col("session_id")], [F.col("player_id")], [F.col("source")], []],
        F.col("session_id"),
        F.col("player_id"),
        F.col("source"),
    ).agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("n").alias("events"),
        F.sum(F.when(F.col("source") == "manual-correction", F.col("n")).otherwise(0)).alias(
            "corrections"
        ),
    )
    return sums.withColumn("rate", F.col("corrections") / F.col("events"))


def calibration_friction(attempts: DataFrame) -> DataFrame:
    """Attempts and seconds up to the first valid calibration of a session."""
    first = attempts.groupBy("session_id").agg(
        F.min("ts").alias("first_try"), F.min(F.when(F.col("valid"), F.col("ts"))).alias("first_valid")
    )
    tries = attempts.join(first, "session_id").groupBy("session_id", "first_try", "first_valid").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("ts") < F.col("first_valid")).alias("failed_before"),
    )
    return tries.select(
        "session_id",
        "attempts",
        F.when(F.col("first_valid").isNotNull(), F.col("failed_before") + 1).alias(
            "attempts_needed"
        ),
        ((micros(F.col("first_valid")) - micros(F.col("first_try"))) / F.lit(1e6)).alias(
            "seconds_needed"
        ),
    )


def runtime_report(
    frames: DataFrame, width: str = "1 minute", resolution: float | None = None
) -> DataFrame:
    """Frames per second and latency by runtime and time window.

    `width` is an interval as Spark reads it. Latencies are counted first, at
    `resolution` milliseconds if given, as in `impact_error`. Battery use is
    averaged where the frames carry it (`battery_mw`).
    """
    latency = _counted(F.col("latency_ms"), resolution)
    battery = [c for c in ("battery_mw",) if c in frames.columns]
    keys = ["runtime", "w"]
    counted = frames.groupBy(
        "runtime", F.window("captured_at", width).alias("w"), latency.alias("_ms")
    ).agg(F.count(F.lit(1)).alias("n"), *[F.sum(b).alias(b) for b in battery])
    seconds = (micros(F.col("w.end")) - micros(F.col("w.start"))) / F.lit(1e6)
    return (
        counted.groupBy(*keys)
        .agg(
            F.sum("n").alias("frames"),
            F.percentile("_ms", F.lit(0.5), F.col("n")).alias("latency_p50"),
            F.percentile("_ms", F.lit(0.95), F.col("n")).alias("latency_p95"),
            *[(F.sum(b) / F.sum("n")).alias(b) for b in battery],
        )
        .select(
            "runtime",
            F.col("w.start").alias("window_start"),
            "frames",
            (F.col("frames") / seconds).alias("frames_per_second"),
            "latency_p50",
            "latency_p95",
            *battery,
        )
    )


def worst_segments(pairs: DataFrame, k: int) -> DataFrame:
    """The k segments with the highest share of corrected detections."""
    return (
        pairs.groupBy("detected_segment")
        .agg(F.count(F.lit(1)).alias("throws"), F.count_if(~F.col("agree")).alias("errors"))
        .withColumn("error_rate", F.col("errors") / F.col("throws"))
        .orderBy(F.col("error_rate").desc(), "detected_segment")
        .limit(k)
    )
