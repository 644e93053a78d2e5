"""Calibration fit, frames, detections, as-of joins."""

import random

import make
import numpy as np
import pytest
from pyspark.sql import functions as F

from ocheline.operators import reports, vision

UNIT = {"n": (0.0, 1.0), "e": (1.0, 0.0), "s": (0.0, -1.0), "w": (-1.0, 0.0)}
LANDMARKS = "calibration_id string, name string, px double, py double, bx double, by0 double"


def pixels(h, points, noise=0.0, rng=None):
    """Board points through the inverse of the image-to-board mapping `h`."""
    inverse = np.linalg.inv(np.array(h).reshape(3, 3))
    out = []
    for bx, by in points:
        u, v, w = inverse @ [bx, by, 1.0]
        out.append((u / w + (rng.gauss(0, noise) if rng else 0), v / w))
    return out


PERSPECTIVE = [0.0031, 0.0002, -2.1, 0.0001, -0.0033, 1.2, 0.00002, 0.00003, 1.0]


def marks(spark, sets):
    rows = [
        (c, n, float(px), float(py), float(bx), float(by))
        for c, named in sets.items()
        for n, (px, py), (bx, by) in named
    ]
    return spark.createDataFrame(rows, LANDMARKS)


def test_fit_identity_and_perspective(spark):
    identity = [(n, p, p) for n, p in UNIT.items()]
    seen = [(n, q, p) for (n, p), q in zip(UNIT.items(), pixels(PERSPECTIVE, UNIT.values()))]
    fitted = {r.calibration_id: r for r in vision.fit_homography(marks(spark, {"i": identity, "p": seen})).collect()}
    assert np.allclose(fitted["p"].h, PERSPECTIVE, rtol=1e-6) and fitted["p"].rank == 8
    assert fitted["i"].rank == 8 or fitted["i"].h is None
    points = [(0.3, 0.4), (-0.7, 0.1), (0.0, 0.0)]
    det = spark.createDataFrame(
        [(i, "p", float(u), float(v)) for i, (u, v) in enumerate(pixels(PERSPECTIVE, points))],
        "i int, calibration_id string, px double, py double",
    )
    back = vision.project_to_board(vision.with_calibration(det, vision.fit_homography(marks(spark, {"p": seen})))).orderBy("i").collect()
    assert np.allclose([(r.x, r.y) for r in back], points, atol=1e-7)


def test_validation(spark):
    rng = random.Random(3)
    names = list(UNIT.items())
    good = [(n, q, p) for (n, p), q in zip(names, pixels(PERSPECTIVE, UNIT.values()))]
    line_points = [(-1.0, 0.0), (-0.3, 0.0), (0.4, 0.0), (1.0, 0.0)]
    line = [(n, q, p) for n, q, p in zip("nesw", pixels(PERSPECTIVE, line_points), line_points)]
    five = [*UNIT.items(), ("c", (0.5, 0.5))]
    near = [(n, q, p) for (n, p), q in zip(five, pixels(PERSPECTIVE, [p for _, p in five], 0.5, rng))]
    far = good + [("c", (good[0][1][0] + 150.0, good[0][1][1] - 90.0), (0.5, 0.5))]
    sets = {"good": good, "three": good[:3], "line": line, "near": near, "far": far}
    m = marks(spark, sets)
    found = {r.calibration_id: r for r in vision.validate_calibration(vision.fit_homography(m), m).collect()}
    assert {k: r.valid for k, r in found.items()} == {"good": True, "three": False, "line": False, "near": True, "far": False}
    assert found["good"].rms < 1e-6 < found["near"].rms < 0.02 < found["far"].rms
    assert (found["three"].n_landmarks, found["three"].rank, found["line"].rank) == (3, 6, 5)


def test_horizon_has_no_board_point(spark):
    df = spark.createDataFrame([(1.0, 1.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0])], "px double, py double, h array<double>")
    assert vision.project_to_board(df).first()["x"] is None


FRAMES = "session_id string, frame_no bigint, captured_at timestamp, n_tips bigint, runtime string, latency_ms double"


def frames(spark, tips, session="s", step=1.0):
    return spark.createDataFrame(
        [(session, i, make.at(i * step), n, "web", float(i)) for i, n in enumerate(tips)], FRAMES
    )


@pytest.mark.parametrize("large", [False, True])
def test_new_throws(spark, request, large):
    if large:
        request.getfixturevalue("hot")
    tips = [1, 1, 2, 3, 0, 0, 2, 1, 1, 3, 0, 1]
    found = vision.detect_throws(frames(spark, tips)).orderBy("frame_no").collect()
    assert [r.new_tips for r in found] == [1, 0, 1, 1, 0, 0, 2, 0, 0, 2, 0, 1]
    assert [r.retrieved for r in found] == [n == 0 and i in (4, 10) for i, n in enumerate(tips)]
    assert [r.throws_so_far for r in found][-1] == 8
    each = vision.throw_candidates(frames(spark, tips)).orderBy("throw_no").collect()
    assert [(r.throw_no, r.frame_no) for r in each] == [(1, 0), (2, 2), (3, 3), (4, 6), (5, 6), (6, 9), (7, 9), (8, 11)]


def test_sampler(spark):
    kept = vision.sample_frames(frames(spark, [0] * 10, step=0.3), 1000).orderBy("frame_no").collect()
    assert [r.frame_no for r in kept] == [0, 4, 7]


DETECTIONS = "throw_id string, session_id string, view int, frame_no bigint, captured_at timestamp, confidence double"


@pytest.mark.parametrize("large", [False, True])
def test_asof_calibration(spark, request, large):
    if large:
        request.getfixturevalue("hot")
    det = spark.createDataFrame(
        [(str(i), "st"[i % 2], 0, i, make.at(i), 0.5) for i in range(20)], DETECTIONS
    )
    cal = spark.createDataFrame(
        [("c1", "s", make.at(4), [1.0]), ("c2", "s", make.at(9), [2.0]), ("c3", "t", make.at(5), [3.0]), ("c4", "t", None, [4.0])],
        "calibration_id string, session_id string, validated_at timestamp, h array<double>",
    )
    found = {int(r.throw_id): r.calibration_id for r in vision.asof_calibration(det, cal).collect()}
    for i in range(20):
        if i % 2 == 0:
            assert found[i] == (None if i < 4 else "c1" if i < 9 else "c2")
        else:
            assert found[i] == (None if i < 5 else "c3")


def test_best_and_fused(spark):
    rows = [("a", "s", 0, 5, make.at(0), 0.4), ("a", "s", 1, 3, make.at(0), 0.8), ("a", "s", 2, 2, make.at(0), 0.8), ("b", "s", 0, 1, make.at(0), 0.0)]
    det = spark.createDataFrame(rows, DETECTIONS)
    assert {r.throw_id: r.frame_no for r in vision.best_tip(det).collect()} == {"a": 2, "b": 1}
    mapped = det.withColumns({"x": F.col("view") * 1.0, "y": F.lit(1.0)})
    fused = {r.throw_id: (r.x, r.y, r.n_views) for r in vision.fuse_views(mapped).collect()}
    assert fused["a"] == (pytest.approx((0.8 + 1.6) / 2.0), pytest.approx(1.0), 3)
    assert fused["b"] == (None, None, 1)


def test_runtime_report(spark):
    report = reports.runtime_report(frames(spark, [0] * 90).withColumn("battery_mw", F.lit(2.0)))
    found = report.orderBy("window_start").collect()
    assert [(r.frames, r.latency_p50, r.battery_mw) for r in found] == [(60, pytest.approx(29.5), 2.0), (30, pytest.approx(74.5), 2.0)]


def test_calibration_friction(spark):
    rows = [("s", make.at(0), False), ("s", make.at(5), False), ("s", make.at(9), True), ("s", make.at(20), False), ("t", make.at(1), False)]
    found = {r.session_id: tuple(r)[1:] for r in reports.calibration_friction(spark.createDataFrame(rows, "session_id string, ts timestamp, valid boolean")).collect()}
    assert found == {"s": (4, 3, 9.0), "t": (1, None, None)}


def test_confusion_matrix(spark):
    pairs = spark.createDataFrame([(20, 20), (20, 5), (20, 5), (1, 1)], "detected_segment int, corrected_segment int")
    found = {r.detected_segment: (r["1"], r["5"], r["20"]) for r in reports.confusion_matrix(pairs, [1, 5, 20]).collect()}
    assert found == {20: (0, 2, 1), 1: (1, 0, 0)}


def test_runtime_windows_of_any_width(spark):
    for width, seconds in (("100 milliseconds", 0.1), ("1 week", 7 * 86400), ("2 minutes", 120)):
        report = reports.runtime_report(frames(spark, [0] * 3), width).collect()
        assert {r.frames_per_second * seconds / r.frames for r in report} == {1.0}


def test_reports_keep_all_pairs_and_real_values(spark):
    pairs = spark.createDataFrame(
        [("1", "9", "s", 0.0, 0.0, 0.123456, 0.0, True), ("2", "2", "t", 0.0, 0.0, 0.0, 0.0, False)],
        "id string, final_id string, session_id string, detected_x double, detected_y double, "
        "corrected_x double, corrected_y double, agree boolean",
    )
    conditions = spark.createDataFrame([("s", "l", "b", "d")], "session_id string, lighting string, board string, dart string")
    total = reports.accuracy_report(pairs, conditions).filter("level = 7").first()
    assert (total.throws, total.agreeing) == (2, 1)
    error = reports.impact_error(pairs).first()
    assert (error.throws, error.p50, error.largest) == (1, 0.123456, 0.123456)
    coarse = reports.impact_error(pairs, corrected_only=False, resolution=0.1).first()
    assert (coarse.throws, coarse.largest) == (2, 0.123456) and abs(coarse.p95 - 0.095) < 1e-9


def test_frames_with_all_landmarks(spark):
    rows = [("s", 1, n) for n in "nesw"] + [("s", 2, n) for n in "nessnn"] + [("t", 1, n) for n in "nes"]
    marks = spark.createDataFrame(rows, "session_id string, frame_no bigint, name string")
    kept = vision.usable_frames(marks.select("session_id", "frame_no").distinct(), marks)
    assert [tuple(r) for r in kept.collect()] == [("s", 1)]
