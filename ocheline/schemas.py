"""Declared schemas and fixed values of the throw event contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Notation, board and source domains.
WEDGES = [20, 1, 18, 4, 13, 6, 10, 15, 2, 17, 3, 19, 7, 16, 8, 11, 14, 9, 12, 5]
BOARD_RADIUS_MM = 170.0
# ring, inner radius mm, outer radius mm, multiplier, fixed segment
RINGS = [
    ("inner_bull", 0.0, 6.35, 2, 25),
    ("outer_bull", 6.35, 15.9, 1, 25),
    ("inner_single", 15.9, 99.0, 1, None),
    ("treble", 99.0, 107.0, 3, None),
    ("outer_single", 107.0, 162.0, 1, None),
    ("double", 162.0, 170.0, 2, None),
]
SOURCES = ["camera", "manual-correction"]
CRICKET_NUMBERS = [15, 16, 17, 18, 19, 20, 25]
LANDMARK_NAMES = ["n", "e", "s", "w"]


def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType(
        [T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields]
    )


_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)

# The event as it is exchanged: one JSON object per throw.
THROW_EVENT = _struct(
    ("id", _S),
    ("sessionId", _S),
    ("playerId", _S),
    ("turnId", _S),
    ("capturedAt", _S),
    ("impact", _struct(("xNormalized", _D), ("yNormalized", _D))),
    (
        "detected",
        _struct(
            ("segment", _I),
            ("multiplier", _I),
            ("score", _I),
            ("notation", _S),
            ("confidence", _D),
        ),
    ),
    ("calibrationId", _S),
    ("source", _S),
    ("correctionOf", _S),
)

# The event as the operators use it: one flat row per throw.
THROWS = _struct(
    ("id", _S),
    ("session_id", _S),
    ("player_id", _S),
    ("turn_id", _S),
    ("captured_at", _TS),
    ("x", _D),
    ("y", _D),
    ("segment", _I),
    ("multiplier", _I),
    ("score", _I),
    ("notation", _S),
    ("confidence", _D),
    ("calibration_id", _S),
    ("source", _S),
    ("correction_of", _S),
)

LANDMARKS = _struct(
    ("calibration_id", _S), ("name", _S), ("px", _D), ("py", _D), ("bx", _D), ("by0", _D)
)

CALIBRATIONS = _struct(
    ("calibration_id", _S),
    ("session_id", _S),
    ("validated_at", _TS),
    ("h", T.ArrayType(_D)),
    ("rank", _I),
)

FRAMES = _struct(
    ("session_id", _S),
    ("frame_no", _L),
    ("captured_at", _TS),
    ("n_tips", _L),
    ("runtime", _S),
    ("latency_ms", _D),
)

DETECTIONS = _struct(
    ("throw_id", _S),
    ("session_id", _S),
    ("view", _I),
    ("frame_no", _L),
    ("captured_at", _TS),
    ("px", _D),
    ("py", _D),
    ("confidence", _D),
    ("calibration_id", _S),
)

GAMES = _struct(
    ("session_id", _S),
    ("game_type", _S),
    ("start_score", _I),
    ("double_out", _B),
    ("started_at", _TS),
)

ISSUES = _struct(
    ("repo", _S),
    ("number", _L),
    ("title", _S),
    ("state", _S),
    ("assignee", _S),
    ("body", _S),
    ("native_parent", _L),
    ("native_blockers", T.ArrayType(_L)),
)
