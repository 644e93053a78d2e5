"""The checks a throw event has to pass, as one array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ocheline.functions import board
from ocheline.schemas import SOURCES


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _fails(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def violations() -> Column:
    """Names of the broken rules, in a fixed order."""
    c = F.col
    checks = [
        ("id", c("id").isNotNull()),
        ("session_id", c("session_id").isNotNull()),
        ("captured_at", c("captured_at").isNotNull()),
        ("impact", _finite(c("x")) & _finite(c("y"))),
        ("segment", c("segment").isin(0, 25) | c("segment").between(1, 20)),
        ("multiplier", c("multiplier").between(0, 3) & board.legal(c("segment"), c("multiplier"))),
        ("score", c("score") == c("segment") * c("multiplier")),
        ("notation", c("notation") == board.notation(c("segment"), c("multiplier"))),
        ("confidence", c("confidence").between(0.0, 1.0)),
        ("calibration_id", c("calibration_id").isNotNull()),
        ("source", c("source").isin(*SOURCES)),
        (
            "correction_of",
            (c("source") == "manual-correction") == c("correction_of").isNotNull(),
        ),
    ]
    return F.array_compact(F.array(*[F.when(_fails(ok), F.lit(name)) for name, ok in checks]))
