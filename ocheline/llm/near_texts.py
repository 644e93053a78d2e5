"""Near-duplicate texts: Jaccard similarity of five-word shingles, confirmed exactly.

A text's set has the 64-bit hashes of its shingles. MinHash deals texts to
BANDS buckets each, of ROWS minima; a pair of similarity s shares none with
probability (1 - s^ROWS)^BANDS, 5e-8 at 0.8 and less above. What shares a
bucket is only a candidate; a link needs the exact similarity of the sets.

First each member of a bucket is held against the smallest one, each pair once
over all buckets, which joins most groups by as many rows as they have members.
Buckets that still hold texts of different groups are then compared in full,
large ones by pairs of tiles, and leave a spanning forest of their links.

Links of another method between the different texts may be given as well; the
groups are then what both connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.llm.components import components
from ocheline.llm.frames import unused
from ocheline.plans.storage import cut_lineage

SHINGLE = 5
# Links need a similarity of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 4
# Members of a bucket that are compared in one task.
TILE = 512
# Pairs that are confirmed at once.
PAIRS = 1024
_FACTORS = np.random.default_rng(20240518).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different shingle hashes of all texts end to end, and where each starts.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a
    shingle is five words (all of a shorter text). A text without words has none.
    """
    data, offsets = tx.flat(column)
    found = tx.words(tx.LOWER[data], offsets, ~tx.SPACE)
    counts = found.counts
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    ends = np.cumsum(shingles)
    begin = np.repeat(found.first[:-1] - (ends - shingles), shingles) + np.arange(int(shingles.sum()))
    size = np.repeat(np.minimum(counts, SHINGLE), shingles)
    hashes = tx.run_hashes(tx.word_hashes(found), begin, size)
    text = np.repeat(np.arange(len(counts)), shingles)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def buckets(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row for each set: its BANDS buckets. Empty sets share all of theirs."""
    out = np.zeros((len(starts) - 1, BANDS), np.uint64)
    some = np.diff(starts) > 0
    for band in range(BANDS):
        key = np.full(int(some.sum()), band + 1, np.uint64)
        for factor in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            if len(key):
                least = np.minimum.reduceat(hashes * factor, starts[:-1][some])
                key = tx.mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[some, band] = key
        out[~some, band] = band
    return out


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members that share some are similar; empty sets are to each other."""
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def bucket_links(sets: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what similar pairs of `sets` and equal values of `group` connect."""
    sizes = np.array([len(s) // 8 for s in sets], np.int64)
    _, group = np.unique(group, return_inverse=True)
    _, members = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    # One zero more after each set, since reduceat has no empty slices.
    starts = np.cumsum(sizes + 1) - sizes - 1
    padded = np.zeros(int((sizes + 1).sum()), np.int64)
    padded[np.arange(len(members)) + np.repeat(np.arange(len(sets)), sizes)] = members + 1
    mark = np.zeros(len(members) + 1, bool)
    first, second = [], []
    done = np.zeros(len(sets), bool)
    while True:
        # A pair of two groups is compared once either side is done, so the largest group may rest.
        rest = np.flatnonzero(~done & (group != np.bincount(group).argmax()))
        if not len(rest):
            return np.array(first, np.int64), np.array(second, np.int64)
        i = int(rest[0])
        done[i] = True
        own = padded[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.add.reduceat(mark[padded], starts, dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(similar(shared, sizes[i], sizes) & (group != group[i])).tolist():
            if group[j] != group[i]:
                first.append(i)
                second.append(j)
                group[group == group[j]] = group[i]


def _digest(text_col: str) -> Column:
    """A text by 256 bits; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, digest, text): each different text once, with a number; written, since numbers must not change."""
    narrow = docs.select(_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    once = narrow.groupBy("digest").agg(F.first("text").alias("text"))
    return cut_lineage(once.withColumn("key", F.monotonically_increasing_id()))


def _visits(texts: DataFrame) -> DataFrame:
    """(bucket, key): the buckets of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, "text", 1 << 20):
            found = buckets(*shingle_sets(part.column("text")))
            keys = np.repeat(part.column("key").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64).ravel()), pa.array(keys)], ["bucket", "key"]
            )

    return texts.select("key", "text").mapInArrow(run, "bucket long, key long")


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hashes binary): the sets of the texts of `keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, "text", 1 << 20):
            hashes, starts = shingle_sets(part.column("text"))
            raw = [hashes[s:e].tobytes() for s, e in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(raw, pa.binary())], ["key", "hashes"]
            )

    return texts.select("key", "text").join(keys, "key", "left_semi").mapInArrow(run, "key long, hashes binary")


def _members(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(members of all sets end to end, which set each is of)."""
    raw = sets.to_pylist()
    sizes = np.array([len(s) // 8 for s in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(sizes)), sizes)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, PAIRS):
                part = batch.slice(s, PAIRS)
                (x, of_x), (y, of_y) = _members(part.column("x")), _members(part.column("y"))
                # A pair's shared members are those that stand there twice.
                every, pair = np.concatenate([x, y]), np.concatenate([of_x, of_y])
                order = np.lexsort((every, pair))
                every, pair = every[order], pair[order]
                twice = (every[1:] == every[:-1]) & (pair[1:] == pair[:-1])
                shared, a, b = (np.bincount(p, minlength=part.num_rows) for p in (pair[1:][twice], of_x, of_y))
                yield part.select(["a", "b"]).filter(pa.array(similar(shared, a, b)))

    both = pairs.join(
        sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a"
    ).join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the `members` (bucket, key, root, n) of a bucket of n, all pairs compared."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        i, j = bucket_links(table.column("hashes").to_pylist(), table.column("root").to_numpy())
        return pa.table({"a": keys[i], "b": keys[j]})

    tiles = F.ceil(F.col("n") / TILE)
    dealt = (
        members.withColumn("tile", F.pmod(F.xxhash64("key", F.lit("tile")), tiles))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
        .select("bucket", "key", "root", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    )
    return (
        dealt.join(sets, "key")
        .groupBy("bucket", "low", "high")
        .applyInArrow(run, "a long, b long")
        .distinct()
    )


def links(texts: DataFrame) -> DataFrame:
    """Links (a, b) of the keys of different texts (key, text) that connect what similar texts connect."""
    visits = cut_lineage(_visits(texts))
    shared = cut_lineage(
        visits.groupBy(F.col("bucket").alias("_bucket"))
        .agg(F.min("key").alias("least"), F.max("key").alias("most"))
        .where("least < most")
        .select("_bucket", "least")
    )
    members = cut_lineage(
        visits.join(shared, F.col("bucket") == F.col("_bucket")).select("bucket", "key", "least").distinct()
    )
    sets = cut_lineage(_sets(texts, members.select("key").distinct()))
    pairs = members.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    first = cut_lineage(_confirmed(pairs, sets))
    roots = components(first)
    rooted = members.join(roots, F.col("key") == F.col("node"), "left").select(
        "bucket", "key", F.coalesce("root", "key").alias("root")
    )
    # Two members are compared already.
    open_ = (
        rooted.groupBy(F.col("bucket").alias("_bucket"))
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        .where("low < high and n > 2")
    )
    left = cut_lineage(
        rooted.join(open_, F.col("bucket") == F.col("_bucket")).select("bucket", "key", "root", "n")
    )
    return cut_lineage(first.unionByName(_compared(left, sets)).distinct())


# Links (a, b) of the keys of different texts (key, text).
Links = Callable[[DataFrame], DataFrame]


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Links | None = None
) -> DataFrame:
    """(`id_col`, component_id) for each row of `docs`.

    component_id is the smallest id reachable over texts of similarity 0.8 or
    more, and over the links of `also`; texts without words are similar to each
    other. Repeated rows are repeated in the result. Null ids take part but are never the smallest; a
    component of null ids only has a null id.
    """
    texts = _texts(docs, text_col)
    marked = cut_lineage(docs.select(F.col(id_col), _digest(text_col).alias("_digest")))
    least = marked.groupBy(F.col("_digest").alias("_of")).agg(F.min(id_col).alias("least"))
    classes = texts.select("key", "digest").join(least, F.col("digest") == F.col("_of"))
    linked = links(texts)
    if also is not None:
        linked = cut_lineage(also(texts).unionByName(linked).distinct())
    found = components(linked)
    rooted = cut_lineage(
        classes.join(found, F.col("key") == F.col("node"), "left").select(
            "digest", "least", F.coalesce("root", "key").alias("root")
        )
    )
    smallest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    ids = rooted.join(smallest, F.col("root") == F.col("_root")).select("digest", "component_id")
    return marked.join(ids, F.col("_digest") == F.col("digest")).select(id_col, "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Links | None = None
) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its near-duplicate group.

    All columns are kept as they are. Rows that repeat an id count as copies:
    one of them stays. Rows without an id stay only if no other of the group
    has one, one for each group.
    """
    mark = unused(docs, "_kept_id")
    kept = (
        near_groups(docs, id_col, text_col, also)
        .where(F.col(id_col).eqNullSafe(F.col("component_id")))
        .select(F.col(id_col).alias(mark))
        .distinct()
    )
    same = docs.join(kept, docs[id_col].eqNullSafe(F.col(mark)), "left_semi")
    return same.dropDuplicates([id_col])
