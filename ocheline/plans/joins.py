"""Joins whose strategy depends on a counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocheline.plans.ordered import hot_limit
from ocheline.plans.storage import cut_lineage

BROADCAST_ROWS = 100_000


def interval_lookup(
    facts: DataFrame,
    value: Column,
    intervals: DataFrame,
    lo: str,
    hi: str,
    cell: float,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join each row to the half-open intervals ``lo <= value < hi``.

    Intervals are spread over the cells of a grid that they touch, which makes
    the range condition an equi-join on the cell. While that makes few rows in
    all, they are broadcast. Otherwise an interval lies on the level of the grid
    whose cells, `cell` times a power of two, are at least as wide as it is: it
    touches three of them at most, so rows follow the number of intervals, not
    their width. A fact looks into one cell of each level that occurs, some
    dozens at most. A cell that holds more facts than the row limit of
    `plans.ordered` is divided by salts, and its intervals are repeated for
    each, so that it is shared by many tasks.
    """
    keyed = facts.withColumn("_value", value)
    given = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    width = F.greatest(F.col(hi) - F.col(lo), F.lit(0.0)) / F.lit(cell)
    level = F.when(width > 1, F.ceil(F.log2(width))).otherwise(F.lit(0)).cast("int")
    touched = F.col(hi) / F.lit(cell) - F.col(lo) / F.lit(cell) + 2
    size = given.agg(F.sum(touched).alias("cells"), F.sort_array(F.collect_set(level)).alias("levels")).first()
    if (size["cells"] or 0) <= max_broadcast_rows:
        return _lookup(keyed, _cells(given, lo, hi, cell), lo, hi, cell, "left", broadcast=True).drop("_value")
    found, rest = [], keyed
    for n in size["levels"]:  # the exponents of a double at most
        cells = cut_lineage(_cells(given.where(level == n), lo, hi, cell * 2.0**n))
        found.append(_lookup(keyed, cells, lo, hi, cell * 2.0**n, "inner"))
        rest = _lookup(rest, cells, lo, hi, cell * 2.0**n, "left_anti")
    out = rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in intervals.schema.fields])
    for more in found:
        out = out.unionByName(more)
    return out.drop("_value")


def _cells(intervals: DataFrame, lo: str, hi: str, cell: float) -> DataFrame:
    """Each interval once for every cell it touches, `_icell`."""
    first, last = (F.floor(F.col(c) / F.lit(cell)) for c in (lo, hi))
    return intervals.withColumn("_icell", F.explode(F.sequence(first, F.greatest(first, last))))


def _lookup(
    facts: DataFrame, cells: DataFrame, lo: str, hi: str, cell: float, how: str, broadcast: bool = False
) -> DataFrame:
    """Join facts by `_value` to the intervals of one grid."""
    keyed = facts.withColumn("_cell", F.floor(F.col("_value") / F.lit(cell)))
    in_range = (F.col("_value") >= F.col(lo)) & (F.col("_value") < F.col(hi))
    if broadcast:
        joined = keyed.join(F.broadcast(cells), (F.col("_cell") == F.col("_icell")) & in_range, how)
        return joined.drop("_cell", "_icell")
    # Only cells with more facts than a task should have are salted, by their size.
    limit = hot_limit(facts)
    crowded = cut_lineage(
        keyed.groupBy(F.col("_cell").alias("_hcell"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .select("_hcell", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    side = (
        cells
        .join(crowded, F.col("_icell") == F.col("_hcell"), "left")
        .withColumn("_isalt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_hcell", "_salts")
    )
    spread = (
        keyed.join(crowded, F.col("_cell") == F.col("_hcell"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), salts).cast("int"))
        .drop("_hcell", "_salts")
    )
    joined = spread.join(
        side,
        (F.col("_cell") == F.col("_icell")) & (F.col("_salt") == F.col("_isalt")) & in_range,
        how,
    )
    return joined.drop("_cell", "_icell", "_salt", "_isalt")
