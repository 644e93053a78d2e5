"""Sharding by a k-d tree over metadata.

Starting from one node that holds all rows, every node that is to give more than
one shard is split along the metadata dimension in which its rows spread
widest, at a weighted quantile: weights are sizes in bytes, and the cut leaves
each side as many bytes as it has shards to give (a median for an even number).

The quantile is exact on codes of 39 bits: 19 for the row's place in the node's
range of that dimension and 20 of a hash that divides rows of the same place, so
that a value which holds most of the rows can be cut as well. It is found in
three rounds of sums over 2^13 buckets for all nodes of a level at once; the
driver sees nothing but numbers of nodes and rows.

Texts are read once. All rounds read a written table of ids, sizes, dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.llm.frames import unused
from ocheline.plans.storage import cut_lineage

PLACE_BITS, TIE_BITS, ROUND_BITS = 19, 20, 13
# A slot is counted in runs of about so many rows.
RUN_ROWS = 100_000


def kd_shards(
    rows: DataFrame,
    size: str,
    dimensions: Sequence[str],
    shards: int | None = None,
    target_bytes: int | None = None,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """`rows` with a shard from 0 on and a slot, gapless from 0 within the shard.

    Give the number of shards, or the bytes that one should have. `size` is a
    positive long; `dimensions` are numeric. Shards are as near to equal in
    bytes as single rows and a hash of 20 bits allow, whatever repeats: equal
    rows may be divided. Null and NaN count as the least value of a dimension. An
    empty table gives an empty result; one row or shards without rows are fine.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    row, tie = unused(rows, "_row"), unused(rows, "_tie")
    dims = [unused(rows, f"_d{k}") for k in range(len(dimensions))]
    weight = unused(rows, "_weight")
    # The number of a row makes equal rows differ; written, since it must not change.
    base = cut_lineage(
        rows.withColumn(row, F.monotonically_increasing_id()).withColumns(
            {
                **{d: _plain(F.col(c)) for d, c in zip(dims, dimensions)},
                tie: F.shiftrightunsigned(F.xxhash64(row), 64 - TIE_BITS),
                weight: F.col(size).cast("long"),
            }
        )
    )
    spread = base.agg(
        F.sum(weight).alias("total"),
        *[(F.max(d) - F.min(d)).alias(d) for d in dims],
    ).first()
    if shards is None:
        shards = max(1, math.ceil((spread["total"] or 0) / target_bytes))
    # Dimensions are measured against the spread of all rows.
    # From here on only columns of our own, whatever those of `rows` are called.
    own = {row: "_row", weight: "_weight", tie: "_tie"} | {d: f"_d{k}" for k, d in enumerate(dims)}
    scale = {own[d]: spread[d] or 1.0 for d in dims}
    placed = base.select(*[F.col(c).alias(n) for c, n in own.items()], F.lit(0).alias("_node"), F.lit(shards).alias("_give"))
    level = shards
    while level > 1:
        placed = cut_lineage(_split(placed, "_row", "_weight", "_tie", list(scale), "_node", "_give", scale))
        level = (level + 1) // 2
    numbered = _numbered(placed.select("_row", F.col("_node").alias("_shard")), "_row", "_shard", "_slot")
    kept = base.drop(tie, weight, *dims, shard_col, slot_col)
    other = unused(base, "_numbered")
    result = kept.join(
        numbered.select(F.col("_row").alias(other), F.col("_shard").alias(shard_col), F.col("_slot").alias(slot_col)),
        F.col(row) == F.col(other),
    )
    names = [c for c in rows.columns if c not in (shard_col, slot_col)]
    return result.select(*names, shard_col, slot_col)


def _plain(value: Column) -> Column:
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(None)).otherwise(number)


def _split(
    placed: DataFrame,
    row: str,
    size: str,
    tie: str,
    dims: Sequence[str],
    node: str,
    give: str,
    scale: dict[str, float],
) -> DataFrame:
    """One level: node becomes the number of its first shard, on either side of the cut.

    The tables of nodes have a row for each node, at most as many as shards;
    Spark broadcasts them while they are below its size threshold.
    """
    stats = placed.where(F.col(give) > 1).groupBy(F.col(node).alias("n")).agg(
        F.sum(size).alias("total"),
        F.max(give).alias("g"),
        *[F.min(d).alias(f"lo{k}") for k, d in enumerate(dims)],
        *[F.max(d).alias(f"hi{k}") for k, d in enumerate(dims)],
    )
    widths = [
        F.coalesce((F.col(f"hi{k}") - F.col(f"lo{k}")) / F.lit(float(scale[d])), F.lit(0.0))
        for k, d in enumerate(dims)
    ]
    widest = F.greatest(*widths) if len(widths) > 1 else widths[0]
    nodes = stats.withColumn("left", F.floor(F.col("g") / 2)).select(
        "n",
        "left",
        # Bytes that the cut leaves on the left, in proportion to the shards.
        (F.col("total").cast("double") * F.col("left") / F.col("g")).alias("want"),
        F.coalesce(*[F.when(w == widest, F.lit(k)) for k, w in enumerate(widths)]).alias("dim"),
        *[F.col(f"{x}{k}") for k in range(len(dims)) for x in ("lo", "hi")],
    )
    nodes = cut_lineage(nodes)
    places = 1 << PLACE_BITS
    scaled = [
        F.when(
            F.col(f"hi{k}") > F.col(f"lo{k}"),
            (F.col(d) - F.col(f"lo{k}")) / (F.col(f"hi{k}") - F.col(f"lo{k}")),
        )
        for k, d in enumerate(dims)
    ]
    share = F.coalesce(F.element_at(F.array(*scaled), F.col("dim") + 1), F.lit(0.0))
    place = F.least(F.floor(share * places), F.lit(places - 1))
    inside = placed.join(nodes, F.col(node) == F.col("n"), "left").withColumn(
        "code", F.when(F.col("n").isNotNull(), place * (1 << TIE_BITS) + F.col(tie))
    )
    coded = cut_lineage(inside.select(row, size, tie, *dims, node, give, "left", "code"))

    # Find, for each node, the code up to which the left side reaches.
    cuts = nodes.select("n", "want", F.lit(0).cast("long").alias("prefix"))
    shift = PLACE_BITS + TIE_BITS
    while shift:
        shift -= ROUND_BITS
        known = coded.where("code is not null").join(
            cuts,
            (F.col(node) == F.col("n"))
            & (F.shiftright("code", shift + ROUND_BITS) == F.col("prefix")),
        )
        sums = known.groupBy("n", F.shiftright("code", shift).alias("bucket")).agg(
            F.sum(size).alias("bytes"), F.first("want").alias("want")
        )
        upto = Window.partitionBy("n").orderBy("bucket")
        before = F.sum("bytes").over(upto) - F.col("bytes")
        cuts = cut_lineage(
            sums.withColumn("before", before)
            .where(F.col("before") <= F.col("want"))
            .groupBy("n")
            .agg(
                F.max_by("want", "bucket").alias("w"),
                F.max("bucket").alias("prefix"),
                F.max("before").alias("b"),
            )
            .select("n", (F.col("w") - F.col("b")).alias("want"), "prefix")
        )
    last = cuts.select(F.col("n").alias("m"), F.col("prefix").alias("cut"))
    right = F.col("code") >= F.col("cut")
    return coded.join(last, F.col(node) == F.col("m"), "left").select(
        row,
        size,
        tie,
        *dims,
        F.when(F.col("m").isNull(), F.col(node))
        .otherwise(F.col(node) + F.when(right, F.col("left")).otherwise(0))
        .cast("int")
        .alias(node),
        F.when(F.col("m").isNull(), F.col(give))
        .otherwise(F.when(right, F.col(give) - F.col("left")).otherwise(F.col("left")))
        .cast("int")
        .alias(give),
    )


def _numbered(placed: DataFrame, row: str, shard: str, slot: str) -> DataFrame:
    """Number the rows of each shard from 0, in runs of bounded length."""
    runs = max(1, math.ceil(placed.count() / RUN_ROWS))
    dealt = placed.withColumn("_run", F.pmod(F.xxhash64(row), F.lit(runs)))
    counts = dealt.groupBy(F.col(shard).alias("_s"), F.col("_run").alias("_r")).agg(
        F.count("*").alias("rows")
    )
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_s", "_r", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(shard, "_run").orderBy(row)
    return (
        dealt.withColumn("_k", F.row_number().over(within) - 1)
        .join(bases, (F.col(shard) == F.col("_s")) & (F.col("_run") == F.col("_r")))
        .select(row, F.col(shard).cast("int").alias(shard), (F.col("base") + F.col("_k")).alias(slot))
    )
