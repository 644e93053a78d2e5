"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocheline.operators import (
    board,
    corrections,
    events,
    games,
    issues,
    recognition,
    reports,
    vision,
)
from ocheline.plans.storage import cut_lineage, session_folder
from registry import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
THRESHOLDS = [0.1, 0.25, 0.5, 0.75, 0.9]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _final(spark: SparkSession, d: str) -> DataFrame:
    """What counts: the originals, with the values of the corrections in force."""
    return corrections.effective_throws(fx.throws(spark, d))


# --- scans and events -------------------------------------------------------


@query
def s8_union_sources(spark, d):
    t = fx.throws(spark, d)
    manual = F.col("source") == "manual-correction"
    both = events.union_sources(t.filter(~manual), t.filter(manual))
    return both.select("id", "session_id", "source", "correction_of", "score")


@query
def p1_validate_throws(spark, d):
    checked = events.validate_throws(fx.throws_broken(spark, d))
    return checked.select("event_id", F.array_join("violations", ",").alias("violations"))


@query
def p2_split_valid(spark, d):
    good, bad = events.split_valid(fx.throws_broken(spark, d))
    return good.select("event_id", F.lit(True).alias("good")).unionByName(
        bad.select("event_id", F.lit(False).alias("good"))
    )


@query
def p3_vendor_leak(spark, d):
    leaks = events.vendor_leak(fx.raw_json(spark, d), "raw")
    return leaks.select("id", F.array_join("leaked", ",").alias("leaked"))


@query
def p4_route_confidence(spark, d):
    return events.route_confidence(fx.throws(spark, d), 0.5).select("id", "confidence", "route")


@query
def p5_visible_frames(spark, d):
    return vision.visible_frames(fx.landmarks(spark, d))


@query
def p5_usable_frames(spark, d):
    kept = vision.usable_frames(fx.frames(spark, d), fx.frame_landmarks(spark, d))
    return kept.select("session_id", "frame_no", "n_tips")


@query
def p6_assemble_throws(spark, d):
    mapped = board.map_segment(fx.points(spark, d).drop("id"))
    made = events.assemble_throws(mapped)
    return made.select(
        "id", "session_id", "player_id", "segment", "multiplier", "score", "notation", "source"
    )


@query
def p7_to_adapter(spark, d):
    return events.to_adapter(fx.throws(spark, d), fx.adapter_mapping(spark), "scores")


@query
def p8_usable_datasets(spark, d):
    return events.usable_datasets(fx.catalogue(spark, d), fx.licences(spark, d))


@query
def g12_dedupe_throws(spark, d):
    once = events.dedupe_throws(fx.throws_dirty(spark, d))
    return once.select("id", "score", "source", "correction_of")


# --- joins ------------------------------------------------------------------


@query
def j1_with_calibration(spark, d):
    joined = vision.with_calibration(fx.detections(spark, d), fx.calibrations(spark, d))
    return joined.select("throw_id", "view", "calibration_id", F.round(F.col("h")[0], 9).alias("h0"))


@query
def j2_asof_calibration(spark, d):
    found = vision.asof_calibration(
        fx.detections(spark, d), fx.calibrations(spark, d), tie="frame_no"
    )
    return found.select("throw_id", "view", "calibration_id")


@query
def j3_asof_game(spark, d):
    t = fx.throws(spark, d).select("id", "session_id", "captured_at")
    return games.asof_game(t, fx.games(spark, d)).select(
        "id", "game_type", "start_score", "double_out", "started_at"
    )


@query
def j4_orphan_calibration(spark, d):
    orphans = events.orphan_calibration(fx.throws(spark, d), fx.calibrations(spark, d))
    return orphans.select("id", "calibration_id")


@query
def j5_orphan_corrections(spark, d):
    return events.orphan_corrections(fx.throws(spark, d)).select("id", "correction_of")


@query
def j6_ring_lookup(spark, d):
    found = board.map_segment(fx.points(spark, d), board.board_spec(spark))
    return found.select("id", "segment", "multiplier")


@query
def j7_authorised(spark, d):
    allowed = events.authorised(fx.throws(spark, d), fx.adapter_grants(spark, d), "scores")
    return allowed.select("id", "session_id")


@query
def j8_close_groupings(spark, d):
    near = games.close_groupings(games.assign_turns(_final(spark, d), fx.throws(spark, d)), 0.25)
    return near.withColumn("distance", F.round("distance", 6))


@query
def j9_detected_vs_corrected(spark, d):
    return corrections.detected_vs_corrected(fx.throws(spark, d)).select(
        "id",
        "final_id",
        "detected_segment",
        "corrected_segment",
        "detected_score",
        "corrected_score",
        "agree",
    )


# --- geometry ---------------------------------------------------------------


@query
def m1_fit_homography(spark, d):
    fitted = vision.fit_homography(fx.landmarks(spark, d))
    return fitted.select(
        "calibration_id",
        "rank",
        *[(F.round(F.col("h")[i], 6) + F.lit(0.0)).alias(f"h{i}") for i in range(9)],
    )


@query
def m2_validate_calibration(spark, d):
    marks = fx.landmarks(spark, d)
    checked = vision.validate_calibration(vision.fit_homography(marks), marks)
    return checked.select("calibration_id", "n_landmarks", F.round("rms", 6).alias("rms"), "valid")


@query
def m3_project_to_board(spark, d):
    found = vision.project_to_board(
        vision.with_calibration(fx.detections(spark, d), fx.calibrations(spark, d))
    )
    return found.select(
        "throw_id",
        "view",
        (F.round("x", 6) + F.lit(0.0)).alias("x"),
        (F.round("y", 6) + F.lit(0.0)).alias("y"),
    )


@query
def m4_map_segment(spark, d):
    return board.map_segment(fx.points(spark, d)).select("id", "segment", "multiplier")


@query
def m5_score(spark, d):
    scored = board.with_score(board.map_segment(fx.points(spark, d)))
    return scored.select("id", "score")


@query
def m6_to_notation(spark, d):
    return board.to_notation(board.map_segment(fx.points(spark, d))).select("id", "notation")


@query
def m7_from_notation(spark, d):
    written = fx.throws(spark, d).select("id", "notation")
    return board.from_notation(written).select("id", "notation", "segment", "multiplier")


# --- aggregations -----------------------------------------------------------


@query
def g1_best_tip(spark, d):
    return vision.best_tip(fx.detections(spark, d)).select("throw_id", "view", "confidence")


@query
def g2_fuse_views(spark, d):
    seen = vision.with_calibration(fx.detections(spark, d), fx.calibrations(spark, d))
    fused = vision.fuse_views(vision.project_to_board(seen))
    return fused.select(
        "throw_id",
        (F.round("x", 6) + F.lit(0.0)).alias("x"),
        (F.round("y", 6) + F.lit(0.0)).alias("y"),
        "confidence",
        "n_views",
    )


@query
def g3_turn_totals(spark, d):
    return games.turn_totals(games.assign_turns(_final(spark, d), fx.throws(spark, d)))


def _pairs(spark, d):
    return corrections.detected_vs_corrected(fx.throws(spark, d))


@query
def g4_accuracy_report(spark, d):
    report = reports.accuracy_report(_pairs(spark, d), fx.conditions(spark, d))
    return report.withColumn("accuracy", F.round("accuracy", 9))


@query
def g5_confusion(spark, d):
    return reports.confusion(_pairs(spark, d))


@query
def g6_impact_error(spark, d):
    errors = reports.impact_error(_pairs(spark, d))
    return errors.select(
        "throws", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "largest")]
    )


def _holds(estimate: Column, share: float, value: Column) -> Column:
    """Whether the share of values up to an estimate is the asked one, with a margin of three errors."""
    margin = 3 * reports.SKETCH_ERROR
    return (F.avg((value < estimate).cast("double")) <= share + margin) & (
        F.avg((value <= estimate).cast("double")) >= share - margin
    )


@query
def g6_sketched(spark, d):
    """G6 from stored daily sketches, held against all distances."""
    folder = f"{session_folder(spark)}/sketches-{uuid.uuid4().hex}"
    pairs = _pairs(spark, d)
    reports.impact_error_sketches(pairs).write.partitionBy("day").parquet(folder)
    merged = reports.impact_error_merged(spark.read.parquet(folder))
    distance = F.hypot(F.col("detected_x") - F.col("corrected_x"), F.col("detected_y") - F.col("corrected_y"))
    every = pairs.filter(F.col("final_id") != F.col("id")).select(distance.alias("d"))
    line = merged.first()  # one row
    return every.agg(
        F.lit(line["throws"]).cast("bigint").alias("throws"),
        F.round(F.lit(line["largest"]).cast("double"), 6).alias("largest"),
        _holds(F.lit(line["p50"]), 0.5, F.col("d")).alias("p50_holds"),
        _holds(F.lit(line["p95"]), 0.95, F.col("d")).alias("p95_holds"),
    )


@query
def g11_sketched(spark, d):
    """G11 by day from stored sketches of hours, held against all latencies."""
    folder = f"{session_folder(spark)}/sketches-{uuid.uuid4().hex}"
    frames = fx.frames(spark, d)
    reports.runtime_sketches(frames, "1 hour").write.parquet(folder)
    merged = reports.runtime_merged(spark.read.parquet(folder), "1 day")
    day = F.window("captured_at", "1 day")["start"]
    each = frames.select(F.col("runtime").alias("_runtime"), day.alias("_day"), "latency_ms")
    held = each.join(merged, (F.col("_runtime") == F.col("runtime")) & (F.col("_day") == F.col("window_start")))
    return held.groupBy("runtime", "window_start", "frames").agg(
        _holds(F.col("latency_p50"), 0.5, F.col("latency_ms")).alias("p50_holds"),
        _holds(F.col("latency_p95"), 0.95, F.col("latency_ms")).alias("p95_holds"),
    )


@query
def g7_threshold_sweep(spark, d):
    return reports.threshold_sweep(_pairs(spark, d), THRESHOLDS)


@query
def g8_confidence_calibration(spark, d):
    lines = reports.confidence_calibration(_pairs(spark, d), 10)
    return lines.withColumns(
        {c: F.round(c, 9) for c in ("mean_confidence", "agreement")}
    )


@query
def g9_correction_rate(spark, d):
    return reports.correction_rate(fx.throws(spark, d)).withColumn("rate", F.round("rate", 9))


@query
def g10_calibration_friction(spark, d):
    return reports.calibration_friction(fx.calibration_attempts(spark, d)).withColumn(
        "seconds_needed", F.round("seconds_needed", 3)
    )


@query
def g11_runtime_report(spark, d):
    report = reports.runtime_report(fx.frames(spark, d), "1 minute")
    return report.select(
        "runtime",
        "window_start",
        "frames",
        *[F.round(c, 6).alias(c) for c in ("frames_per_second", "latency_p50", "latency_p95")],
    )


# --- windows ----------------------------------------------------------------


@query
def w1_sample_frames(spark, d):
    kept = vision.sample_frames(fx.frames(spark, d), 6 * 3600 * 1000)
    return kept.select("session_id", "slot", "frame_no")


@query
def w2_detect_throws(spark, d):
    return vision.detect_throws(fx.frames(spark, d)).select(
        "session_id", "frame_no", "n_tips", "new_tips", "retrieved", "throws_so_far"
    )


@query
def w3_assign_turns(spark, d):
    return games.assign_turns(_final(spark, d), fx.throws(spark, d)).select("id", "turn_no", "dart_no")


def _with_given_turns(throws: DataFrame) -> DataFrame:
    """Two of three sessions get turn ids, which may end a turn early or go on beyond three darts."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("captured_at"))
    name = F.concat(F.lit("t"), F.floor(micros / 1_000_000 / 40_000).cast("string"))
    n = F.substring("session_id", 2, 20).cast("bigint")
    return throws.withColumn("turn_id", F.when(n % 3 > 0, name))


@query
def w3_given_turns(spark, d):
    return games.assign_turns(_with_given_turns(_final(spark, d))).select("id", "turn_no", "dart_no")


@query
def e1_given_turns(spark, d):
    """X01 where a turn ends with its id, or after three darts."""
    states = games.x01_states(_with_given_turns(_final(spark, d)), fx.games(spark, d))
    return states.select("id", "turn_no", "dart_no", "remaining", "status")


@query
def w4_running_score(spark, d):
    return games.running_score(_final(spark, d), fx.throws(spark, d)).select("id", "running_score")


@query
def w5_cricket_marks(spark, d):
    return games.cricket_marks(_final(spark, d), counted=fx.throws(spark, d)).select(
        "id", "segment", "marks", "marks_so_far"
    )


@query
def w6_cricket_points(spark, d):
    return games.cricket_points(_final(spark, d), counted=fx.throws(spark, d)).select(
        "id", "points", "points_so_far", "closes", "numbers_closed", "wins", "after"
    )


@query
def w7_scoreboard(spark, d):
    t = games.running_score(_final(spark, d), fx.throws(spark, d))
    return games.scoreboard(t, ["running_score"])


@query
def w8_worst_segments(spark, d):
    return reports.worst_segments(_pairs(spark, d), 5).withColumn(
        "error_rate", F.round("error_rate", 9)
    )


# --- corrections and games --------------------------------------------------


@query
def r1_resolve_corrections(spark, d):
    return corrections.resolve_corrections(fx.throws(spark, d))


@query
def r1_by_recursion(spark, d):
    return corrections.resolve_corrections(fx.throws(spark, d), recursion=True)


@query
def r2_effective_throws(spark, d):
    return corrections.effective_throws(fx.throws(spark, d)).select(
        "id", "player_id", "segment", "multiplier", "score", "notation", "confidence", "final_id"
    )


@query
def r3_correction_lineage(spark, d):
    return corrections.correction_lineage(fx.throws(spark, d))


@query
def r3_correction_history(spark, d):
    """R3 with the corrections that lost to a rival."""
    return corrections.correction_history(fx.throws(spark, d))


@query
def e1_x01_states(spark, d):
    t = fx.throws(spark, d)
    final = corrections.effective_throws(t)
    return games.x01_states(final, fx.games(spark, d), counted=t).select(
        "id", "turn_no", "dart_no", "remaining", "status"
    )


@query
def e1_long_legs(spark, d):
    """X01 where a leg is folded in several pieces."""
    states = games.x01_states(fx.long_throws(spark, d), fx.long_games(spark))
    return states.select("id", "turn_no", "dart_no", "remaining", "status")


@query
def e5_frames_to_states(spark, d):
    """The whole way: frames, throws, tips, calibrations, segments, events, game."""
    seen = recognition.throws_from_frames(
        fx.frames(spark, d), fx.tips(spark, d), fx.calibrations(spark, d)
    )
    return games.x01_states(seen, fx.games(spark, d)).select(
        "id", "turn_no", "dart_no", "remaining", "status"
    )


@query
def e2_cricket_standings(spark, d):
    t = fx.throws(spark, d)
    final = corrections.effective_throws(t)
    return games.cricket_standings(final, fx.games(spark, d), counted=t)


@query
def e3_fold_game(spark, d):
    """Another game by the same fold: lives lost on a dart of less than ten, points doubled by a treble."""
    state = games.fold_game(
        _final(spark, d),
        ["session_id", "player_id"],
        lambda: F.struct(F.lit(0).cast("bigint").alias("lost"), F.lit(0).cast("bigint").alias("points")),
        lambda s, dart: F.struct(
            (s["lost"] + F.when(dart["score"] < 10, 1).otherwise(0)).alias("lost"),
            (s["points"] + dart["score"] * F.when(dart["multiplier"] == 3, 2).otherwise(1)).alias("points"),
        ),
    )
    return state.select("session_id", "player_id", "state.lost", "state.points")


def _lives(state: Column, dart: Column) -> Column:
    """Three lives: a dart below ten costs one, a treble gives one back; none is none for good."""
    gone, won = dart["score"] < 10, dart["multiplier"] == 3
    return F.when(state == 0, 0).when(won, F.least(state + 1, F.lit(3))).when(gone, state - 1).otherwise(state)


@query
def e3_fold_states(spark, d):
    """A game of few states, folded in parallel."""
    found = games.fold_states(_final(spark, d), ["session_id", "player_id"], 4, 3, _lives)
    return found.select("session_id", "player_id", F.col("state").alias("lives"))


@query
def e4_replay_diff(spark, d):
    """What resolving the corrections changes in the turn totals."""
    t = fx.throws(spark, d)
    detected = t.filter(F.col("correction_of").isNull())
    final = corrections.effective_throws(t)
    # A run is a table; its rows are read for the digest and, where they differ, for the comparison.
    a, b = (cut_lineage(games.turn_totals(games.assign_turns(x, t))) for x in (detected, final))
    return games.replay_diff(a, b)


# --- issue tables -----------------------------------------------------------


@query
def i1_classify_issues(spark, d):
    return issues.classify_issues(fx.issues(spark, d)).select("repo", "number", "kind")


@query
def i2_parse_ticket(spark, d):
    parsed = issues.parse_ticket(issues.tickets(fx.issues(spark, d)))
    return parsed.select(
        "repo",
        "number",
        "parent",
        "ticket_type",
        F.array_join(F.transform("blockers", lambda b: b.cast("string")), ",").alias("blockers"),
    )


@query
def i3_bad_questions(spark, d):
    return issues.bad_questions(fx.issues(spark, d)).select("repo", "number", "n_questions")


@query
def i4_map_sections(spark, d):
    lacking = issues.map_sections(fx.issues(spark, d))
    return lacking.select("repo", "number", F.array_join("missing", ",").alias("missing"))


@query
def i5_parents(spark, d):
    return issues.parents(fx.issues(spark, d))


@query
def i6_blocking_edges(spark, d):
    return issues.blocking_edges(fx.issues(spark, d))


@query
def i7_frontier(spark, d):
    return issues.frontier(fx.issues(spark, d)).select("repo", "number")


@query
def i8_claim_audit(spark, d):
    return issues.claim_audit(fx.issues(spark, d), fx.activity(spark, d))


@query
def i9_resolution_audit(spark, d):
    return issues.resolution_audit(fx.issues(spark, d), fx.comments(spark, d))


@query
def i10_branch_audit(spark, d):
    return issues.branch_audit(fx.branches(spark, d))


@query
def i11_map_progress(spark, d):
    return issues.map_progress(fx.issues(spark, d))
