"""Running values over ordered groups, also where one group is very large.

A plain window puts a whole group into one task. That is the right plan while
groups are of ordinary size: one shuffle on the group key serves every window.
A group above the row limit is cut into consecutive chunks instead. Each chunk
is scanned on its own, and what it inherits from the chunks before it comes
from one summary row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.plans.storage import cut_lineage

LIMIT_SETTING = "spark.ocheline.hotGroupRows"
DEFAULT_LIMIT = 2_000_000
CHUNK = "_chunk"
# Hot groups hold more than `limit` rows each, so there are few of them; above
# this number the table of their keys is shuffled rather than broadcast.
MAX_BROADCAST_GROUPS = 100_000


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(DEFAULT_LIMIT)))


def over_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    body: Callable[..., DataFrame],
    noted: Column | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Apply `body`, made of `running` steps, to groups of any size.

    Ordinary groups go through `body` as they are. The rows of over-large ones
    go through it a second time, cut into chunks. With a condition `noted`,
    `body` is also told whether it holds for any row, which is found out in
    the pass that counts the groups. That pass reads `counted` where it is
    given: a frame with at least the rows of `df` that is cheaper to evaluate.
    """
    cold, hot, found = _split(df, keys, order, noted, counted)
    told = () if noted is None else (found,)
    done = body(cold, *told)
    return done if hot is None else done.unionByName(body(hot, *told).drop(CHUNK))


def split_hot(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups, and those of over-large groups if there are any.

    The latter are sorted over many tasks (range partitions on key and order)
    and get the number of their partition as `_chunk`, so that no chunk mixes
    the order of two others. They are written at that point, since the number
    must not change when a task is repeated.
    """
    return _split(df, keys, order, None, None)[:2]


def _split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    noted: Column | None,
    counted: DataFrame | None,
) -> tuple[DataFrame, DataFrame | None, bool]:
    """`split_hot`, and whether `noted` holds for any row, with one pass over `df` or `counted`."""
    limit = hot_limit(df)
    names = [f"_hot_{k}" for k in keys]
    sizes = (
        (df if counted is None else counted)
        .groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.bool_or(F.lit(False) if noted is None else noted).alias("_noted"),
        )
    )
    large = F.col("_rows") > limit
    found = sizes.agg(
        F.count_if(large).alias("groups"),
        F.sum(F.when(large, F.col("_rows"))).alias("rows"),
        F.bool_or("_noted").alias("noted"),
    ).first()
    if not found["groups"]:
        return df, None, bool(found["noted"])
    sizes = cut_lineage(sizes.filter(large).drop("_rows", "_noted"))
    if found["groups"] <= MAX_BROADCAST_GROUPS:
        sizes = F.broadcast(sizes)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    parts = max(2, math.ceil(2 * found["rows"] / limit))
    hot = (
        df.join(sizes, same, "left_semi")
        .repartitionByRange(parts, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id())
    )
    return df.join(sizes, same, "left_anti"), cut_lineage(hot), bool(found["noted"])


def is_split(df: DataFrame) -> bool:
    return CHUNK in df.columns


@dataclass(frozen=True)
class Running:
    kind: str
    expr: Column


def total(expr: Column) -> Running:
    """Sum of the rows so far, this one included; 0 where all are null."""
    return Running("total", expr)


def peak(expr: Column) -> Running:
    """Largest value so far."""
    return Running("peak", expr)


def latest(expr: Column) -> Running:
    """Last value so far that is not null."""
    return Running("latest", expr)


def previous(expr: Column) -> Running:
    """Value of the row before, null on the first."""
    return Running("previous", expr)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Running]
) -> DataFrame:
    """Add running columns per `keys` in the total order `order`.

    Meant for the body of `over_groups`; chunks must follow the same order.
    """
    if not is_split(df):
        rows = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: _plain(r, rows) for name, r in columns.items()})

    here = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    # Written, because it is read twice: by the chunk summaries and by the join.
    local = cut_lineage(
        df.withColumns({f"_l_{name}": _local(r, here) for name, r in columns.items()})
    )
    position = F.struct(*order)
    parts = local.groupBy(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk")
    ).agg(*[_summary(r, position).alias(f"_s_{name}") for name, r in columns.items()])
    before = (
        Window.partitionBy(*[f"_k_{k}" for k in keys])
        .orderBy("_k_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = parts.select(
        *[f"_k_{k}" for k in keys],
        "_k_chunk",
        *[_carry(r, f"_s_{name}", before).alias(f"_c_{name}") for name, r in columns.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = local.join(carried, [*same, F.col(CHUNK) == F.col("_k_chunk")])
    return joined.withColumns(
        {name: _combine(r, f"_l_{name}", f"_c_{name}") for name, r in columns.items()}
    ).select(*[c for c in df.columns if c not in columns], *columns)


def _plain(r: Running, window) -> Column:
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if r.kind == "total":
        return F.coalesce(F.sum(r.expr).over(so_far), F.lit(0))
    if r.kind == "peak":
        return F.max(r.expr).over(so_far)
    if r.kind == "latest":
        return F.last(r.expr, ignorenulls=True).over(so_far)
    return F.lag(r.expr).over(window)


def _local(r: Running, window) -> Column:
    # A struct tells "the row before held null" from "no row before".
    return _plain(previous(F.struct(r.expr.alias("v"))) if r.kind == "previous" else r, window)


def _summary(r: Running, position: Column) -> Column:
    if r.kind == "total":
        return F.sum(r.expr)
    if r.kind == "peak":
        return F.max(r.expr)
    if r.kind == "latest":
        return F.max_by(r.expr, F.when(r.expr.isNotNull(), position))
    return F.max_by(F.struct(r.expr.alias("v")), position)


def _carry(r: Running, column: str, before) -> Column:
    if r.kind == "total":
        return F.sum(column).over(before)
    if r.kind == "peak":
        return F.max(column).over(before)
    return F.last(column, ignorenulls=True).over(before)


def _combine(r: Running, local: str, carried: str) -> Column:
    if r.kind == "total":
        return F.col(local) + F.coalesce(F.col(carried), F.lit(0))
    if r.kind == "peak":
        return F.greatest(local, carried)
    if r.kind == "latest":
        return F.coalesce(local, carried)
    return F.coalesce(local, carried)["v"]


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    tie: str,
    payload: Sequence[str],
    check_hot: bool = True,
) -> DataFrame:
    """Give each left row the payload of the last right row at or before its time.

    Both sides go into one ordered scan, so there is one shuffle on `keys` and
    no range join. `tie` orders left rows of the same time; of two right rows at
    one instant the greater payload wins. A caller that already knows there is
    no over-large group passes ``check_hot=False``.
    """
    carried = F.struct(*[F.col(c) for c in payload])
    stamps = right.select(
        *keys,
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        carried.alias("_payload"),
        F.lit(None).cast(left.schema[tie].dataType).alias("_tie"),
        *[
            F.lit(None).cast(left.schema[c].dataType).alias(c)
            for c in left.columns
            if c not in keys
        ],
    )
    rows = left.select(
        *keys,
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(stamps.schema["_payload"].dataType).alias("_payload"),
        F.col(tie).alias("_tie"),
        *[c for c in left.columns if c not in keys],
    )
    order = ["_at", "_side", "_tie", "_payload"]
    both = rows.unionByName(stamps)

    def scan(rows: DataFrame) -> DataFrame:
        return running(rows, keys, order, {"_found": latest(F.col("_payload"))})

    scanned = over_groups(both, keys, order, scan) if check_hot else scan(both)
    return scanned.filter(F.col("_side") == 1).select(
        *left.columns, *[F.col("_found")[c].alias(c) for c in payload]
    )
