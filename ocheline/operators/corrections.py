"""Corrections: chains followed to their end, history kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.plans.storage import cut_lineage

VALUE = ["x", "y", "segment", "multiplier", "score", "notation", "confidence"]


@dataclass(frozen=True)
class Chains:
    """`links`: each correction in force with its root and its step (1, 2, …).
    `cycles`: corrections that only name each other and so have no root."""

    links: DataFrame
    cycles: DataFrame


def winning_corrections(throws: DataFrame) -> DataFrame:
    """Per corrected event the correction in force: the later (time, id)."""
    rank = F.struct("captured_at", "id")
    return (
        throws.filter(F.col("correction_of").isNotNull())
        .groupBy(F.col("correction_of").alias("parent"))
        .agg(F.max(rank).alias("_last"))
        .select(F.col("_last.id").alias("id"), "parent")
    )


# So many corrections of corrections are followed by recursion if asked for.
LEVELS = 16


def follow_chains(throws: DataFrame, recursion: bool = False) -> Chains:
    """Root and step of every correction in force.

    With `recursion` one recursive query goes down LEVELS steps from the roots,
    which is all for usual chains. What it does not reach, deeper chains and
    cycles, is left to pointer doubling, which does everything without it.
    """
    links = cut_lineage(winning_corrections(throws))
    if not recursion:
        return _doubled(links)
    near = _recursed(links)
    far = cut_lineage(links.join(near.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti"))
    if far.isEmpty():
        return Chains(near, far.select("id"))
    # A far chain starts at a correction that is reached, or never.
    rest = _doubled(far)
    above = near.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("step").alias("_step"))
    joined = rest.links.join(above, F.col("root") == F.col("_id"), "left").select(
        "id", F.coalesce("_root", "root").alias("root"), (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step")
    )
    return Chains(near.unionByName(joined), rest.cycles)


def _recursed(links: DataFrame) -> DataFrame:
    """(id, root, step) of the links (id, parent) at most LEVELS steps below a root."""
    spark = links.sparkSession
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # each link occurs once, so there is nothing to run away
    try:
        return cut_lineage(
            spark.sql(
                """
WITH RECURSIVE chain AS (
    SELECT l.id, l.parent AS root, 1 AS step FROM {links} l LEFT ANTI JOIN {links} p ON l.parent = p.id
    UNION ALL
    SELECT l.id, c.root, c.step + 1 FROM chain c JOIN {links} l ON l.parent = c.id WHERE c.step < {levels})
SELECT id, root, step FROM chain""",
                links=links,
                levels=LEVELS,
            )
        )
    finally:
        spark.conf.set(limit, before)


def _doubled(links: DataFrame) -> Chains:
    """The same for links (id, parent) of any depth, by pointer doubling.

    An event has at most one correction in force and a correction names one
    event, so every join below is one to one and the corrections halve their
    distance to the root in each round. What stops moving is a cycle.
    """
    open_links = links.select("id", F.col("parent").alias("root"), F.lit(1).alias("step"))
    left, done = None, None
    while left != 0:
        # A link whose target is no open link has arrived, or takes over the
        # root of a target that arrived before; the others jump to where their
        # target points. So each round at least the nearest open links arrive.
        known = _targets(open_links, False)
        if done is not None:
            # Of those that have arrived only the ones that an open link points to.
            aims = open_links.select(F.col("root").alias("_aim"))
            wanted = done.join(aims, F.col("id") == F.col("_aim"), "left_semi")
            known = known.unionByName(_targets(wanted, True))
        moved = cut_lineage(
            open_links.join(known, F.col("root") == F.col("_id"), "left").select(
                "id",
                F.coalesce("_root", "root").alias("root"),
                (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"),
                (F.col("_id").isNull() | F.col("_arrived")).alias("arrived"),
            )
        )
        arrived = moved.filter("arrived").drop("arrived")
        done = arrived if done is None else done.unionByName(arrived)
        open_links = moved.filter(~F.col("arrived")).drop("arrived")
        still = open_links.count()
        if still == left:
            break
        left = still
    return Chains(done, open_links.select("id"))


def _targets(links: DataFrame, arrived: bool) -> DataFrame:
    return links.select(
        F.col("id").alias("_id"),
        F.col("root").alias("_root"),
        F.col("step").alias("_step"),
        F.lit(arrived).alias("_arrived"),
    )


def resolve_corrections(throws: DataFrame, recursion: bool = False) -> DataFrame:
    """Per corrected event the last correction, and how the chain ended.

    `status` is 'resolved', 'orphan' (the first corrected event is not in the
    table), 'superseded' (the chain hangs on a correction that lost to a rival)
    or 'cycle' (`root` is null, `final_id` a member of the cycle).
    """
    chains = follow_chains(throws, recursion)
    ends = chains.links.groupBy("root").agg(
        F.max_by("id", "step").alias("final_id"), F.max("step").alias("n_steps")
    )
    known = throws.select(F.col("id").alias("_known"), F.col("correction_of").alias("_of"))
    status = (
        F.when(F.col("_known").isNull(), "orphan")
        .when(F.col("_of").isNotNull(), "superseded")
        .otherwise("resolved")
    )
    resolved = ends.join(known, F.col("root") == F.col("_known"), "left").select(
        "root",
        "final_id",
        F.col("n_steps").cast("bigint").alias("n_steps"),
        status.alias("status"),
    )
    cycles = chains.cycles.select(
        F.lit(None).cast("string").alias("root"),
        F.col("id").alias("final_id"),
        F.lit(None).cast("bigint").alias("n_steps"),
        F.lit("cycle").alias("status"),
    )
    return resolved.unionByName(cycles)


def _with_finals(throws: DataFrame) -> DataFrame:
    """Originals with the event in force (`final_id`) and its values (`final`)."""
    # Chains that hang on a lost or a losing event have a root that is no
    # original, so the join with the originals leaves them out.
    ends = follow_chains(throws).links.groupBy("root").agg(F.max_by("id", "step").alias("final_id"))
    finals = (
        throws.filter(F.col("correction_of").isNotNull())
        .select(F.col("id").alias("final_id"), F.struct(*VALUE).alias("final"))
        .join(ends, "final_id")
    )
    originals = throws.filter(F.col("correction_of").isNull())
    joined = originals.join(finals, F.col("id") == F.col("root"), "left")
    return joined.select(
        *throws.columns,
        F.coalesce("final_id", "id").alias("final_id"),
        F.when(F.col("root").isNotNull(), F.col("final")).otherwise(F.struct(*VALUE)).alias("final"),
    )


def effective_throws(throws: DataFrame) -> DataFrame:
    """R2: originals with their final values; corrections are removed.

    Time, player, turn and place stay those of the original. `final_id` is the
    event the values come from.
    """
    return _with_finals(throws).select(
        *[
            F.col("final")[c].alias(c) if c in VALUE else c
            for c in throws.columns
            if c != "correction_of"
        ],
        "final_id",
    )


def correction_lineage(throws: DataFrame) -> DataFrame:
    """Every corrected event step by step, with the value at each step.

    One row per step, so a chain of any length stays distributed.
    """
    links = follow_chains(throws).links
    steps = links.unionByName(
        links.select("root").distinct().select(
            F.col("root").alias("id"), "root", F.lit(0).alias("step")
        )
    )
    values = throws.select("id", "notation", "score", "confidence", "source")
    return steps.join(values, "id").select(
        "root",
        F.col("step").cast("bigint").alias("step"),
        "id",
        "notation",
        "score",
        "confidence",
        "source",
    )


def correction_history(throws: DataFrame) -> DataFrame:
    """R3 with rivals: every correction below its root, also those that lost, step by step.

    A row per event, so a root with any number of rivals stays distributed.
    `in_force` says whether the event is part of the chain that counts: the root
    itself and the corrections in force below it. What hangs on a correction that
    lost is not in force. Cycles have no root and are left out.
    """
    every = throws.filter(F.col("correction_of").isNotNull()).select("id", F.col("correction_of").alias("parent"))
    below = _doubled(cut_lineage(every)).links
    counts = follow_chains(throws).links.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    marked = below.join(counts, (F.col("id") == F.col("_id")) & (F.col("root") == F.col("_root")), "left").select(
        "id", "root", "step", F.col("_id").isNotNull().alias("in_force")
    )
    roots = marked.select("root").distinct().select(
        F.col("root").alias("id"), "root", F.lit(0).alias("step"), F.lit(True).alias("in_force")
    )
    values = throws.select("id", "notation", "score", "confidence", "source")
    return marked.unionByName(roots).join(values, "id").select(
        "root", F.col("step").cast("bigint").alias("step"), "id", "notation", "score", "confidence", "source", "in_force"
    )


def detected_vs_corrected(throws: DataFrame) -> DataFrame:
    """The detected value next to the corrected one, for every original."""
    compared = ["segment", "multiplier", "score", "x", "y"]
    agree = F.col("segment").eqNullSafe(F.col("final.segment")) & F.col(
        "multiplier"
    ).eqNullSafe(F.col("final.multiplier"))
    return _with_finals(throws).select(
        "id",
        "final_id",
        "session_id",
        "player_id",
        "captured_at",
        "confidence",
        *[F.col(c).alias(f"detected_{c}") for c in compared],
        *[F.col("final")[c].alias(f"corrected_{c}") for c in compared],
        agree.alias("agree"),
    )
