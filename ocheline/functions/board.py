"""Column functions from board point to segment, score and notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ocheline.schemas import BOARD_RADIUS_MM, RINGS, WEDGES


def radius(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def wedge(x: Column, y: Column) -> Column:
    """Number of the wedge, clockwise from the top; a wire belongs to the next wedge."""
    clockwise = F.degrees(F.atan2(x, y)) + F.lit(369.0)
    place = F.floor((clockwise % F.lit(360.0)) / F.lit(18.0)).cast("int")
    return F.element_at(F.expr(f"array({', '.join(map(str, WEDGES))})"), place + 1)


def _by_ring(r: Column, values: list[Column], outside: Column) -> Column:
    chosen = outside
    for (_, _, outer, _, _), value in zip(reversed(RINGS), reversed(values)):
        chosen = F.when(r < F.lit(outer / BOARD_RADIUS_MM), value).otherwise(chosen)
    return chosen


def segment(x: Column, y: Column) -> Column:
    number = wedge(x, y)
    values = [number if fixed is None else F.lit(fixed) for *_, fixed in RINGS]
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, _by_ring(radius(x, y), values, F.lit(0)))


def multiplier(x: Column, y: Column) -> Column:
    values = [F.lit(m) for *_, m, _ in RINGS]
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, _by_ring(radius(x, y), values, F.lit(0)))


def score(seg: Column, mult: Column) -> Column:
    return (seg * mult).cast("int")


def notation(seg: Column, mult: Column) -> Column:
    """S, D or T and the number; SB and DB for the bulls; MISS; null if impossible."""
    letter = F.element_at(F.array(F.lit("S"), F.lit("D"), F.lit("T")), mult)
    return (
        F.when((seg == 0) & (mult == 0), F.lit("MISS"))
        .when((seg == 25) & (mult == 1), F.lit("SB"))
        .when((seg == 25) & (mult == 2), F.lit("DB"))
        .when(seg.between(1, 20) & mult.between(1, 3), F.concat(letter, seg.cast("string")))
    )


def parsed_notation(text: Column) -> Column:
    """Struct (segment, multiplier) of a notation, null where it is not one."""
    number = F.regexp_extract(text, r"^[SDT]([1-9]|1[0-9]|20)$", 1).try_cast("int")
    letter = F.substring(text, 1, 1)
    by_letter = F.when(letter == "S", 1).when(letter == "D", 2).when(letter == "T", 3)

    def pair(seg: Column, mult: Column) -> Column:
        return F.struct(seg.cast("int").alias("segment"), mult.cast("int").alias("multiplier"))

    return (
        F.when(text == "MISS", pair(F.lit(0), F.lit(0)))
        .when(text == "SB", pair(F.lit(25), F.lit(1)))
        .when(text == "DB", pair(F.lit(25), F.lit(2)))
        .when(number.isNotNull(), pair(number, by_letter))
    )


def legal(seg: Column, mult: Column) -> Column:
    return (
        ((seg == 0) & (mult == 0))
        | ((seg == 25) & mult.isin(1, 2))
        | (seg.between(1, 20) & mult.between(1, 3))
    )
