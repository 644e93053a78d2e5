"""SimHash near-duplicates: exact Hamming neighbours by sharded vantage-point trees.

A document's fingerprint has 64 bits over its 3-word shingles. Equal
fingerprints are one row from then on. A vantage-point tree, built on a bounded
sample of fingerprints, deals the rows out to shards: at each node a fingerprint
goes inside or outside, by whether its Hamming distance to the node's vantage
point is below the node's radius. By the triangle inequality a neighbour within
`radius` bits can be on the other side only if the distance lies within `radius`
of the node's; such boundary fingerprints visit the other side as guests too. So
every pair within `radius` meets in a shard, whatever the sample was.

A shard is compared in blocks. Only a spanning forest of its links leaves it, so
a group of m near copies yields at most m - 1 rows per shard, not m^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.llm.components import components
from ocheline.plans.storage import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 2
# The tree only decides who shares a shard, never the result. It is built on
# at most SAMPLE fingerprints, PER_SHARD for each shard; a shard holds about
# SHARD_ROWS rows of its own up to 2^MAX_DEPTH shards, and more beyond that.
SAMPLE = 1 << 22
PER_SHARD = 32
MAX_DEPTH = 20
SHARD_ROWS = 2000
BLOCK = 1 << 18


def _fingerprints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    data, offsets = tx.flat(batch.column(column))
    found = tx.joined(tx.words(tx.LOWER[data], offsets, ~tx.SPACE))
    counts = found.counts
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    ends = np.cumsum(shingles)
    # shingle j of text t starts at word first[t] + j and has min(3, n_words) words
    begin = np.repeat(found.first[:-1] - (ends - shingles), shingles) + np.arange(int(shingles.sum()))
    last = begin + np.repeat(np.minimum(counts, SHINGLE), shingles) - 1
    raw, digest = found.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(raw[s:e], SEED)
            for s, e in zip(found.starts[begin].tolist(), found.ends[last].tolist())
        ),
        np.uint64,
        len(begin),
    )
    out = np.zeros(len(counts), np.uint64)
    some = shingles > 0
    if some.any():
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (ends - shingles)[some], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little")
        out[some] = packed.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, fp long): the SimHash of each whole text.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a
    shingle is three words (all of a shorter text), repeats count, and a bit is
    set if it is set in over half of the shingles' XXH64. Null and empty texts
    and texts of white space have fingerprint 0. One row per input row; null
    ids stay null; other columns are not looked at.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, "text", 1 << 20):
            fp = _fingerprints(part, "text").view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp)], ["id", "fp"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, fp long").select(F.col("id").alias(id_col), "fp")


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete tree of `depth` levels: vantage point and radius of each inner node.

    Nodes are numbered as in a heap from 1. A node's vantage point is the
    sample fingerprint of its own subset with the smallest spread value, its
    radius the median distance; a node without sample rows sends all outside.
    """
    vantage = np.zeros(1 << depth, np.uint64)
    radius = np.zeros(1 << depth, np.int16)
    sample = np.unique(sample)
    node = np.ones(len(sample), np.int64)
    for level in range(depth):
        order = np.lexsort((tx.mixed(sample), node))
        sample, node = sample[order], node[order]
        here, start = np.unique(node, return_index=True)
        vantage[here] = sample[start]
        far = np.bitwise_count(sample ^ vantage[node]).astype(np.int16)
        for n, s, e in zip(here, start, np.append(start[1:], len(node))):
            radius[n] = max(1, int(np.median(far[s:e])))
        node = 2 * node + (far >= radius[node])
    return vantage, radius


def route(
    fps: np.ndarray, vantage: np.ndarray, radius: np.ndarray, depth: int, reach: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of fingerprint, leaf, whether as a guest) for the leaves each one visits.

    A row's own way goes by the radius. The other side of a node is visited if
    a neighbour within `reach` may be there; of two rows on different sides
    only the inner one visits, so each pair meets once there.
    """
    index = np.arange(len(fps))
    node = np.ones(len(fps), np.int64)
    guest = np.zeros(len(fps), bool)
    for _ in range(depth):
        far = np.bitwise_count(fps[index] ^ vantage[node]).astype(np.int16)
        edge = radius[node]
        out = far >= edge
        # a guest goes wherever a host within reach may be, a host as a guest outwards
        inner = guest & out & (far - reach < edge)
        outer = ~out & (far + reach >= edge)
        node = 2 * node + out
        index = np.concatenate([index, index[inner], index[outer]])
        node = np.concatenate([node, node[inner] - 1, node[outer] + 1])
        guest = np.concatenate([guest, np.ones(int(inner.sum() + outer.sum()), bool)])
    return index, node - (1 << depth), guest


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of n nodes cut down to one link of each node to its smallest peer."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            nodes = np.flatnonzero(root != np.arange(n))
            return nodes, root[nodes]


def shard_links(fps: np.ndarray, guest: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `reach` between a shard's rows.

    Pairs of two guests are left to the shard where one of them is at home.
    """
    fps, guest = fps[np.argsort(guest, kind="stable")], np.sort(guest)
    hosts = fps[~guest]
    lower, upper = [], []
    step = max(1, BLOCK // max(1, len(fps)))
    for s in range(0, len(hosts), step):
        near = np.bitwise_count(hosts[s : s + step, None] ^ fps[None, s:]) <= reach
        i, j = np.nonzero(near)
        keep = j > i  # columns start at s as well, so j > i is one half of the matrix
        a, b = forest(i[keep] + s, j[keep] + s, len(fps))
        lower.append(a)
        upper.append(b)
    if not lower:
        return fps[:0], fps[:0]
    a, b = forest(np.concatenate(lower), np.concatenate(upper), len(fps))
    return fps[a], fps[b]


def hamming_links(prints: DataFrame, reach: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect what fingerprints within `reach` bits connect.

    `prints` has one column fp of distinct longs. The links join each print to
    the smallest of those it hangs together with in a shard; their connected
    components are those of all true pairs. Shards grow in number with
    the input; the tree is broadcast, with at most 2^MAX_DEPTH nodes.
    """
    total = prints.count()
    wanted = max(0, int(np.ceil(np.log2(max(1, total) / SHARD_ROWS))))
    depth = min(wanted, MAX_DEPTH)
    # A bounded sample by hash: every row has the same chance, at any size.
    share = min(1.0, min(SAMPLE, PER_SHARD << depth) / max(1, total))
    sample = (
        prints.where(F.pmod(F.xxhash64(F.col("fp"), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
        .limit(2 * SAMPLE)
        .toArrow()
        .column("fp")
        .to_numpy()
        .astype(np.int64)
        .view(np.uint64)
        if depth
        else np.zeros(0, np.uint64)
    )
    tree = prints.sparkSession.sparkContext.broadcast(build_tree(sample, depth))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(every), 10_000):
                fps = every[s : s + 10_000]
                index, leaf, guest = route(fps, *tree.value, depth, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(fps[index].view(np.int64)), pa.array(guest)],
                    ["shard", "fp", "guest"],
                )

    def link(table: pa.Table) -> pa.Table:
        a, b = shard_links(
            table.column("fp").to_numpy().view(np.uint64),
            table.column("guest").to_numpy(),
            reach,
        )
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # A row may come to a shard by several ways, as a guest or at home.
    visits = (
        prints.mapInArrow(deal, "shard int, fp long, guest boolean")
        .groupBy("shard", "fp")
        .agg(F.min("guest").alias("guest"))
    )
    return visits.groupBy("shard").applyInArrow(link, "a long, b long").distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = RADIUS
) -> DataFrame:
    """(`id_col`, fp, component_id) for each row of `docs`.

    component_id is the smallest id reachable over fingerprints that differ in
    at most `reach` bits; texts without words have fingerprint 0 and link like
    any other. Repeated rows are repeated in the result. Null ids take part but
    are never the smallest; a component of null ids only has a null id. An
    empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = cut_lineage(hamming_links(classes.select("fp"), reach))
    found = components(links)
    rooted = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    ids = rooted.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("fp").alias("_fp"), "component_id"
    )
    return marked.join(ids, F.col("fp") == F.col("_fp")).select(id_col, "fp", "component_id")


def near_links(texts: DataFrame, reach: int = RADIUS) -> DataFrame:
    """Links (a, b) of the keys of `texts` (key, text) that connect what fingerprints within `reach` bits connect."""
    groups = near_groups(texts, "key", "text", reach)
    return groups.where("key <> component_id").select(F.col("component_id").alias("a"), F.col("key").alias("b"))
