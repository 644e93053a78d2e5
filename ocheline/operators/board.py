"""Board point to segment, multiplier, score and notation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.functions import board
from ocheline.plans.joins import interval_lookup
from ocheline.schemas import BOARD_RADIUS_MM, RINGS

# Cells of the ring lookup; a ring of the usual board touches a few of them.
RING_CELL = 1 / 64


def board_spec(spark) -> DataFrame:
    """The default board as a table."""
    rows = [
        (ring, lo / BOARD_RADIUS_MM, hi / BOARD_RADIUS_MM, mult, fixed)
        for ring, lo, hi, mult, fixed in RINGS
    ]
    return spark.createDataFrame(
        rows, "ring string, lo double, hi double, multiplier int, fixed_segment int"
    )


def map_segment(df: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """M4: add segment and multiplier of the point (x, y).

    Without `spec` the usual board is compiled into the expression. With it the
    ring is looked up in the table (J6).
    """
    x, y = F.col("x"), F.col("y")
    if spec is None:
        return df.withColumns({"segment": board.segment(x, y), "multiplier": board.multiplier(x, y)})
    columns = [c for c in df.columns if c not in ("segment", "multiplier")]
    rings = spec.select(
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
        F.col("multiplier").alias("_multiplier"),
        F.col("fixed_segment").alias("_fixed"),
    )
    found = interval_lookup(
        df.select(*columns), board.radius(x, y), rings, "_lo", "_hi", RING_CELL
    )
    known = x.isNotNull() & y.isNotNull()
    hit = F.col("_multiplier").isNotNull()
    seg = F.when(hit, F.coalesce("_fixed", board.wedge(x, y))).otherwise(F.lit(0))
    return found.select(
        *columns,
        F.when(known, seg).cast("int").alias("segment"),
        F.when(known, F.coalesce("_multiplier", F.lit(0))).cast("int").alias("multiplier"),
    )


def with_score(df: DataFrame) -> DataFrame:
    """M5: score = segment x multiplier."""
    return df.withColumn("score", board.score(F.col("segment"), F.col("multiplier")))


def to_notation(df: DataFrame) -> DataFrame:
    """M6: add the notation of (segment, multiplier)."""
    return df.withColumn("notation", board.notation(F.col("segment"), F.col("multiplier")))


def from_notation(df: DataFrame) -> DataFrame:
    """M7: add segment and multiplier of the notation; null where it is none."""
    pair = board.parsed_notation(F.col("notation"))
    return df.withColumns({"segment": pair["segment"], "multiplier": pair["multiplier"]})
