"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.plans.storage import cut_lineage

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Nodes `node` with the smallest node `root` they can reach, for `edges` (a, b).

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node
    hands its smallest neighbour to the others. The number of rows never grows
    and a chain of any length takes few rounds. Only sums per node (a minimum,
    added up before the shuffle) and an equi-join on the node are needed, so a
    hub's links need not meet in one task. Each round is written, so a lost
    executor costs one round. Loops and null ends are left out; nodes without
    a link to another are not in the result.
    """
    links = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        links = cut_lineage(_small_star(_large_star(links)))
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components: no end in sight")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("m")
    )
    return (
        both.join(least, F.col("a") == F.col("node"))
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    # Here a > b: the smaller neighbours of a node are given to the smallest.
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    linked = links.join(least, F.col("a") == F.col("node")).where("b <> m")
    return (
        linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        .distinct()
    )
