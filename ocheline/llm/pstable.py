"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised, so a cosine is a distance. In each of TABLES tables a
vector falls into the bucket that HASHES random projections, shifted and cut
into cells of width CELL, give it together with its label. Vectors that share a
bucket are compared by cosine in double precision.

Equal vectors of a label are one row from the start. A bucket is compared in
blocks and emits, for each member that has a link, the number of vectors it is
linked to and the smallest member it hangs together with: a row per member,
whatever the number of pairs. A pair that meets in several tables counts in the
first of them. Buckets of more than TILE members are compared tile by tile, all
pairs of tiles, so that no task holds more than two tiles.

With CELL 1, HASHES 5 and TABLES 24 a pair of cosine 0.93 meets with probability
0.989, one of 0.95 with 0.998 (Datar et al., 2004).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.llm.components import components
from ocheline.llm.vptree import forest
from ocheline.plans.storage import cut_lineage

COSINE = 0.93
TABLES = 24
HASHES = 5
CELL = 1.0
TILE = 2048
PAIRS = 1 << 20
SEED = 7


def projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (size x TABLES * HASHES) and shifts, the same in every task."""
    random = np.random.default_rng([SEED, size])
    return (
        random.normal(size=(size, TABLES * HASHES)),
        random.uniform(0, CELL, TABLES * HASHES),
    )


def codes(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A 64-bit bucket number for each vector and table; vectors have length 1."""
    directions, shifts = projections(vectors.shape[1])
    cells = np.floor((vectors @ directions + shifts) / CELL).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(vectors), TABLES, HASHES)
    start = tx.mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(vectors.shape[1]) * np.uint64(1 << 40))
    out = start[:, None] + np.arange(TABLES, dtype=np.uint64)[None]
    for k in range(HASHES):
        out = tx.mixed(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return out


def stored(rows: pa.Array, kind: str) -> pa.Array:
    """The components of each usable vector as bytes of the type they are stored in; null for others."""
    lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    raw = np.full(len(rows), None, object)
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        values = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        vectors = values.astype(kind).reshape(-1, size)
        ok = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        for k, one in zip(at[ok], vectors[ok]):
            raw[k] = one.tobytes()
    return pa.array(raw, pa.binary())


def units(raws: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of stored ones of the same length."""
    vectors = np.frombuffer(b"".join(raws), kind).astype(np.float64).reshape(len(raws), -1)
    vectors /= np.abs(vectors).max(axis=1)[:, None]
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return vectors


class Bucket:
    """Members of some buckets, stored one after the other."""

    def __init__(self, batch: pa.RecordBatch, kind: str) -> None:
        self.kind = kind
        self.keys = batch.column("key").to_numpy()
        self.copies = batch.column("copies").to_numpy()
        self.tile = batch.column("tile").to_numpy()
        self.table = batch.column("tab").to_numpy()
        self.raw = batch.column("vector")
        self.size = pc.binary_length(self.raw).to_numpy()

    def vectors(self, s: int, e: int) -> np.ndarray:
        return units(self.raw.slice(s, e - s).to_pylist(), self.kind)

    def codes(self, at: np.ndarray) -> np.ndarray:
        """The buckets of some members in all tables; their labels do not matter, for they are equal."""
        out = np.zeros((len(at), TABLES), np.uint64)
        for size in np.unique(self.size[at]):
            some = np.flatnonzero(self.size[at] == size)
            for s in range(0, len(some), PAIRS // 256):
                part = some[s : s + PAIRS // 256]
                vectors = units(self.raw.take(pa.array(at[part])).to_pylist(), self.kind)
                out[part] = codes(vectors, np.zeros(len(part), np.int64))
        return out

    def links(self, s: int, e: int, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of the members s to e that are links; `cross`: of different tiles only."""
        vectors = self.vectors(s, e)
        step = max(1, PAIRS // (e - s))
        for a in range(0, e - s, step):
            i, j = np.nonzero(vectors[a : a + step] @ vectors[a:].T >= COSINE)
            keep = j > i
            i, j = i[keep] + a + s, j[keep] + a + s
            if cross:
                other = self.tile[i] != self.tile[j]
                i, j = i[other], j[other]
            yield i, j

    def small(self, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All links of the buckets of n members each that begin at `starts`."""
        if not len(starts):
            return starts, starts
        at = (starts[:, None] + np.arange(n)).ravel()
        vectors = units(self.raw.take(pa.array(at)).to_pylist(), self.kind).reshape(len(starts), n, -1)
        k, i, j = np.nonzero(np.matmul(vectors, vectors.transpose(0, 2, 1)) >= COSINE)
        keep = j > i
        return starts[k[keep]] + i[keep], starts[k[keep]] + j[keep]


def _bucket_rows(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    """(key, links, root) of the members with links of whole groups (bucket, low, high)."""
    b = Bucket(batch, kind)
    group = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
    new = np.append(True, (group[1:] != group[:-1]).any(axis=1))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    cross = batch.column("low").to_numpy()[starts] != batch.column("high").to_numpy()[starts]
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, 17):
        rows = starts[(sizes == n) & ~cross]
        for size in np.unique(b.size[rows]):  # lengths differ between buckets only
            some = rows[b.size[rows] == size]
            for s in range(0, len(some), 20_000):
                i, j = b.small(some[s : s + 20_000], n)
                first.append(i)
                second.append(j)
    for s, n, c in zip(starts, sizes, cross):
        if n > 16 or (c and n > 1):
            for i, j in b.links(int(s), int(s + n), bool(c)):
                first.append(i)
                second.append(j)
    i, j = np.concatenate(first), np.concatenate(second)
    # A pair counts in the first table where its codes agree.
    once = np.zeros(len(i), bool)
    paired, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = b.codes(paired)
    for s in range(0, len(i), PAIRS // 8):
        part = slice(s, min(s + PAIRS // 8, len(i)))
        agree = own[at[part]] == own[at[len(i) + part.start : len(i) + part.stop]]
        once[part] = agree.argmax(axis=1) == b.table[i[part]]
    links = np.zeros(len(b.keys), np.int64)
    np.add.at(links, i[once], b.copies[j[once]])
    np.add.at(links, j[once], b.copies[i[once]])
    order = np.argsort(b.keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    node, root = forest(place[i], place[j], len(order))
    linked = np.union1d(np.flatnonzero(links), order[node])
    roots = b.keys.copy()
    roots[order[node]] = b.keys[order[root]]
    return pa.RecordBatch.from_arrays(
        [pa.array(b.keys[linked]), pa.array(links[linked]), pa.array(roots[linked])],
        ["key", "links", "root"],
    )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut between groups (bucket, low, high) only."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
        last = int(np.flatnonzero((group != group[-1]).any(axis=1)).max(initial=-1)) + 1
        if rest and last == 0:
            before = rest[-1].slice(rest[-1].num_rows - 1)
            if all(before.column(c)[0].as_py() == int(v) for c, v in zip(("bucket", "low", "high"), group[0])):
                rest.append(batch)
                continue
        if rest or last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)]).combine_chunks().to_batches()[0]
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(`id_col`, n_links, component_id, kept) for each row.

    Rows of equal labels are linked if their cosine is COSINE or more. Rows
    with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components, have no links; nor have vectors of different length
    with each other. component_id is the smallest id reachable; a null id is
    never the smallest, and a row with a null id and no other in its component
    has a null component and is not kept. Repeated rows are linked as copies.
    """
    narrow = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")
    )

    # Vectors travel as they are stored; what is made of them is made again where it is needed.
    kind = "<f4" if narrow.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = stored(batch.column("v"), kind)
            labelled = batch.column("label").is_valid()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pc.if_else(labelled, raw, pa.scalar(None, pa.binary()))],
                ["id", "label", "vector"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    rows = cut_lineage(
        narrow.withColumn("label", F.col("label").cast("long"))
        .mapInArrow(clean, f"id {kinds['id']}, label long, vector binary")
    )
    classes = cut_lineage(
        rows.where("vector is not null")
        .groupBy("label", "vector")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        .withColumn("key", F.monotonically_increasing_id())
    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("vector")
            sizes = pc.binary_length(raws).to_numpy()
            labels, keys = batch.column("label").to_numpy(), batch.column("key").to_numpy()
            for size in np.unique(sizes):
                every = np.flatnonzero(sizes == size)
                for s in range(0, len(every), 500):
                    at = every[s : s + 500]
                    some = raws.take(pa.array(at))
                    found = codes(units(some.to_pylist(), kind), labels[at])
                    each = pa.array(np.repeat(np.arange(len(at)), TABLES))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.view(np.int64).ravel()),
                            pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))),
                            pa.array(np.repeat(keys[at], TABLES)),
                            batch.column("copies").take(pa.array(at)).take(each),
                            some.take(each),
                        ],
                        ["bucket", "tab", "key", "copies", "vector"],
                    )

    visits = classes.select("label", "vector", "copies", "key").mapInArrow(
        visit, "bucket long, tab int, key long, copies long, vector binary"
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            yield _bucket_rows(batch, kind)

    linked = cut_lineage(
        _tiled(visits)
        .repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high")
        .mapInArrow(link, "key long, links long, root long")
    )
    counts = linked.groupBy(F.col("key").alias("_key")).agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    rooted = (
        classes.join(roots, F.col("key") == F.col("node"), "left")
        .join(counts, F.col("key") == F.col("_key"), "left")
        .select(
            "label",
            "vector",
            "least",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    smallest = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("smallest"))
    known = rooted.join(smallest, F.col("root") == F.col("_root")).select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), "n_links", "smallest"
    )
    found = rows.join(
        known, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left"
    )
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _tiled(visits: DataFrame) -> DataFrame:
    """Members of large buckets once for each pair of tiles that theirs is in."""
    sizes = visits.groupBy(F.col("bucket").alias("_bucket")).agg(F.count("*").alias("n"))
    # At most one in TILE of the visits is such a bucket.
    large = cut_lineage(
        sizes.where(F.col("n") > TILE).select("_bucket", F.ceil(F.col("n") / TILE).alias("tiles"))
    )
    if large.isEmpty():
        return visits.withColumns({c: F.lit(0).cast("long") for c in ("tile", "low", "high")})
    own = F.pmod(F.xxhash64("key"), F.col("tiles"))
    return (
        visits.join(large, F.col("bucket") == F.col("_bucket"), "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
        .withColumn("tile", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .drop("_bucket", "tiles", "other")
    )
