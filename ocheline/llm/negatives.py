"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Vectors are whole numbers; a score is their inner product. A search asks, for an
anchor, for the first rows by score (ties by id) with a score in a window
[lo, hi]. It starts with a threshold well above lo and joins all pairs that reach
it; windows that are not full then ask again with a lower one, until they are
full or at lo.

A join for a threshold t works on a block of rows and a chunk of anchors:

- Dimensions are ordered by weight. By Cauchy and Schwarz a pair's score over the
  last dimensions is at most the product of both suffix norms. So a row's
  dimensions from the place on where that is below t for every anchor are left
  out of the index: a pair that the index does not bring up cannot reach t.
- Postings are walked dimension group by dimension group and add up partial
  scores; a pair goes when its partial score and its remaining norms stay below t.
- What is left gets the omitted dimensions too and with them its exact score.

Blocks are dealt by a hash of the row, so a label with a third of all rows is in
all of them alike; each anchor chunk meets each block once a round, in a task of
its own, and leaves at most the wanted number of rows for a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.llm import text as tx
from ocheline.plans.storage import cut_lineage

SCALE = 256.0
POSITIVES = NEGATIVES = 5
# A negative has a score of at least LOW[0] / LOW[1] of the positive's, and at most that.
LOW = (4, 5)
# How far below the top the thresholds lie, as shares of the span; then the window's lower end.
POSITIVE_LEVELS = (0.35, 0.6, 0.75)
NEGATIVE_LEVELS = (0.3,)
# Bytes of a block of rows and of a chunk of windows, at most but for one row.
BLOCK_BYTES = 8 << 20
LEAST_BLOCK_BYTES = 256 << 10
# Pairs that are held at once, and dimensions that are added at once.
CELLS = 1 << 20
GROUP = 8
# Whole numbers and squared lengths beyond which scores would not fit a long.
MOST_WHOLE = 2.0**31
MOST_SQUARE = 2.0**62
# Tasks of a round, beyond which one has several pairs of block and chunk.
MOST_TASKS = 20_000
_NONE = -(1 << 63)


class Index:
    """Rows of one length, their dimensions by weight, and the norms of what follows each group."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        size = rows.shape[1]
        order = np.argsort(-np.square(rows.astype(np.float64)).sum(axis=0), kind="stable")
        self.rows, self.anchors = rows[:, order], anchors[:, order]
        self.groups = [slice(s, min(s + GROUP, size)) for s in range(0, size, GROUP)]
        self.row_norms, self.anchor_norms = self._suffix(self.rows), self._suffix(self.anchors)
        # Sums of products are at most the product of the norms: exact as doubles up to 2^53.
        exact = self.row_norms[:, 0].max(initial=0) * self.anchor_norms[:, 0].max(initial=0) < 2.0**52
        self.kind = np.float64 if exact else np.int64
        self.rows, self.anchors = self.rows.astype(self.kind), self.anchors.astype(self.kind)

    def _suffix(self, values: np.ndarray) -> np.ndarray:
        """Norm of the dimensions from each group on (a little up), and of none."""
        squares = [np.square(values[:, g].astype(np.float64)).sum(axis=1) for g in self.groups]
        sums = np.cumsum(squares[::-1], axis=0)[::-1].T if squares else np.zeros((len(values), 0))
        return np.sqrt(np.concatenate([sums, np.zeros((len(values), 1))], axis=1)) * (1 + 1e-9)

    def pairs(self, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of the pairs that reach their anchor's threshold, some anchors at a time."""
        step = max(1, CELLS // max(1, len(self.rows)))
        for s in range(0, len(least), step):
            of = np.arange(s, min(s + step, len(least)))
            yield self._some(of, least[of])

    def _some(self, of: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        norms = self.anchor_norms[of]
        # The group from which on a row's dimensions are not indexed.
        covered = self.row_norms * norms.max(axis=0) < least.min()
        indexed = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.groups))
        order = np.argsort(-indexed, kind="stable")  # a posting list is then the first rows
        order = order[indexed[order] > 0]
        partial = np.zeros((len(of), len(order)), self.kind)
        alive = np.ones(partial.shape, bool)
        done = 0
        for g, dims in enumerate(self.groups):
            posted = int(np.searchsorted(-indexed[order], -g, "left"))  # those indexed beyond g
            if not posted:
                break
            partial[:, :posted] += self.anchors[of][:, dims] @ self.rows[order[:posted], dims].T
            # What may still come: from the next group on, or from where the index ends.
            rest = np.minimum(g + 1, indexed[order])
            alive = partial + norms[:, rest] * self.row_norms[order, rest][None] >= least[:, None]
            some = alive.any(axis=0)
            if np.count_nonzero(some) < 0.8 * len(some):
                order, partial, alive = order[some], partial[:, some], alive[:, some]
            done = g + 1
            if np.count_nonzero(alive) <= 0.1 * alive.size:
                break
        anchor, at = np.nonzero(alive)
        row, score = order[at], partial[anchor, at]
        added = np.minimum(indexed, done)
        for g, dims in enumerate(self.groups):
            # What was not added yet: omitted dimensions, and those after the walk ended.
            add = np.flatnonzero(added[row] <= g)
            if not len(add):
                continue
            score[add] += (self.anchors[of[anchor[add]], dims] * self.rows[row[add], dims]).sum(axis=1)
            rest = np.maximum(g + 1, added[row])
            keep = score + norms[anchor, rest] * self.row_norms[row, rest] >= least[anchor]
            anchor, row, score = anchor[keep], row[keep], score[keep]
        keep = score >= least[anchor]
        return of[anchor[keep]], row[keep], score[keep].astype(np.int64)


def _matrices(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length of vectors; empty ones have one zero."""
    lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        values = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(size), at, values.reshape(len(at), size) if size else np.zeros((len(at), 1), np.int64)))
    return out


def best(rows: pa.RecordBatch, windows: pa.RecordBatch, same: bool, most: int) -> pa.RecordBatch:
    """(anchor, window, id, score): the first `most` rows of a block for each window.

    `rows` has id, label, vector; `windows` has anchor (a key), own (its id),
    label, vector, window, hi and least. `same`: rows of equal labels, else of others.
    """
    anchors, first, which = np.unique(windows.column("anchor").to_numpy(), return_index=True, return_inverse=True)
    of_anchor = windows.take(pa.array(first))
    hi, least = windows.column("hi").to_numpy(), windows.column("least").to_numpy()
    bound = np.full(len(anchors), np.iinfo(np.int64).max)
    np.minimum.at(bound, which, least)
    # A little lower, for what rounding does to large ones; windows are cut exactly in the end.
    reach = bound.astype(np.float64)
    reach -= np.abs(reach) * 1e-12
    by_anchor = np.argsort(which, kind="stable")
    of_window = np.searchsorted(which[by_anchor], np.arange(len(anchors) + 1))
    label, own_label = rows.column("label").to_numpy(), of_anchor.column("label").to_numpy()
    place = np.empty(rows.num_rows, np.int64)
    place[pc.sort_indices(rows.column("id"), null_placement="at_end").to_numpy()] = np.arange(rows.num_rows)
    by_size = {size: (at, m) for size, at, m in _matrices(rows)}
    taken, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    scores = [np.zeros(0, np.int64)]

    def choose(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        keep = (label[j] == own_label[i]) == same
        own, theirs = of_anchor.column("own").take(pa.array(i)), rows.column("id").take(pa.array(j))
        keep &= ~pc.equal(own, theirs).fill_null(False).to_numpy(zero_copy_only=False)
        i, j, score = i[keep], j[keep], score[keep]
        sort = np.lexsort((place[j], -score, i))
        i, j, score = i[sort], j[sort], score[sort]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], len(i))):
            down = -score[s:e]
            for w in by_anchor[of_window[i[s]] : of_window[i[s] + 1]]:
                begin = int(np.searchsorted(down, -hi[w], "left"))
                end = len(down) if least[w] <= _NONE else int(np.searchsorted(down, -least[w], "right"))
                at = np.arange(begin, min(begin + most, end)) + s
                taken.append(j[at])
                scores.append(score[at])
                of.append(np.full(len(at), w))

    for size, at, vectors in _matrices(of_anchor):
        if size not in by_size:
            continue
        row_at, matrix = by_size[size]
        for one in np.unique(own_label[at]) if same else (None,):
            mine = np.flatnonzero(own_label[at] == one) if same else np.arange(len(at))
            theirs = np.flatnonzero(label[row_at] == one) if same else np.arange(len(row_at))
            if len(theirs):
                for i, j, score in Index(matrix[theirs], vectors[mine]).pairs(reach[at[mine]]):
                    choose(at[mine[i]], row_at[theirs[j]], score)
    w = pa.array(np.concatenate(of))
    return pa.RecordBatch.from_arrays(
        [
            windows.column("anchor").take(w),
            windows.column("window").take(w),
            rows.column("id").take(pa.array(np.concatenate(taken))),
            pa.array(np.concatenate(scores)),
        ],
        ["anchor", "window", "id", "score"],
    )


@dataclass(frozen=True)
class Blocks:
    """The rows (block, raw), so many blocks, and the type of their ids."""

    frame: DataFrame
    count: int
    kind: str


def _packed(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, raw): the rows of each group as one value."""

    def pack(table: pa.Table) -> pa.Table:
        batch = table.select(list(columns)).combine_chunks().to_batches()[0]
        return pa.table({by: table.column(by)[:1], "raw": pa.array([tx.packed(batch)], pa.binary())})

    return df.select(by, *columns).groupBy(by).applyInArrow(pack, f"{by} int, raw binary")


def _dealt(df: DataFrame, key: str, name: str, size: int, least: int) -> tuple[DataFrame, int]:
    """`df` with a column that deals rows to so many groups by a hash of `key`; and their number."""
    total = df.agg(F.sum(F.size("vector") * 8 + 32)).first()[0] or 0
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-total // size), min(tasks, -(-total // least)))
    return df.withColumn(name, F.pmod(F.xxhash64(key, F.lit(name)), F.lit(groups)).cast("int")), groups


def _round(blocks: Blocks, windows: DataFrame, same: bool, most: int) -> DataFrame:
    """The first rows of all blocks for each window, with their place `rank` from 1 on."""
    dealt, n_chunks = _dealt(windows, "anchor", "chunk", BLOCK_BYTES, BLOCK_BYTES)
    chunks = _packed(dealt, "chunk", ("anchor", "own", "label", "vector", "window", "hi", "least"))
    left = blocks.frame.select(
        "block", F.col("raw").alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")
    ).repartition(min(blocks.count * n_chunks, MOST_TASKS), "block", "chunk")
    right = chunks.select(
        F.col("chunk").alias("_chunk"), F.col("raw").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks.count - 1))).alias("_block")
    )
    met = left.join(right, (F.col("block") == F.col("_block")) & (F.col("chunk") == F.col("_chunk")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column("rows"), batch.column("asked")):
                (rows,), (asked,) = tx.unpacked(rows.as_py()), tx.unpacked(asked.as_py())
                yield best(rows, asked, same, most)

    found = met.select("rows", "asked").mapInArrow(run, f"anchor long, window int, id {blocks.kind}, score long")
    place = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def search(
    blocks: Blocks, windows: DataFrame, same: bool, most: int, levels: Sequence[float]
) -> DataFrame:
    """(anchor, window, id, score, rank) of the first `most` rows of each window [lo, hi].

    `windows` also has `top` and `span`: the thresholds are `top` less the shares
    `levels` of `span`, none below lo, and in the end lo itself.
    """
    asked, results = windows, []
    for level in [*levels, None]:
        least = F.col("lo") if level is None else F.greatest("lo", F.col("top") - F.floor(F.col("span") * level))
        asked = cut_lineage(asked.withColumn("least", least))
        found = cut_lineage(_round(blocks, asked, same, most))
        counts = found.groupBy(F.col("anchor").alias("_a"), F.col("window").alias("_w")).agg(F.count("*").alias("_n"))
        state = asked.join(counts, (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w")), "left")
        full = (F.coalesce("_n", F.lit(0)) >= most) | (F.col("least") <= F.col("lo"))
        state = cut_lineage(state.withColumn("full", full).drop("_a", "_w", "_n"))
        done = state.where("full").select(F.col("anchor").alias("_a"), F.col("window").alias("_w"))
        results.append(found.join(done, (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w")), "left_semi"))
        asked = state.where("not full").drop("full", "least")
        if asked.isEmpty():
            break
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return cut_lineage(out)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(key, id, label, vector array<long>, self): the usable rows, floor(SCALE * x) of each component."""
    narrow = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values * SCALE)
                fits = np.isfinite(values) & (np.abs(whole) < MOST_WHOLE)
            row = np.repeat(np.arange(len(lengths)), lengths)
            usable = np.bincount(row[~fits], minlength=len(lengths)) == 0
            whole = np.where(fits, whole, 0).astype(np.int64)
            usable &= np.bincount(row, np.square(whole.astype(np.float64)), len(lengths)) <= MOST_SQUARE
            ends = np.append(0, np.cumsum(lengths))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(whole))
            sums = np.append(0, np.cumsum(whole * whole))  # modulo 2^64, as are their differences
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), lists, pa.array(np.diff(sums[ends]))],
                ["id", "label", "vector", "self"],
            ).filter(pa.array(usable))

    given = narrow.where("label is not null and v is not null")
    return given.mapInArrow(run, f"id {kind}, label long, vector array<long>, self long").withColumn(
        "key", F.monotonically_increasing_id()
    )


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = LOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says of a row, by the column `id`, whether it is one. A score is the
    inner product of floor(256 * x); first come high scores, ties by smaller id,
    null ids last. An anchor's positives are its first `positives` rows of equal
    label and another id; for each the first `negatives` rows of other labels
    with low * positive_score <= negative_score <= positive_score follow. No row
    means that there is none. Rows with a null label or vector, or a null or
    non-finite component, take no part, nor do those with |floor(256 * x)| of
    2^31 and more or a squared length beyond 2^62, whose scores would not fit a
    long. Vectors of different length have no score. Repeated rows are rows of
    their own, but a row with the anchor's id is not "another". An empty table
    gives an empty result; other columns are not looked at.
    """
    rows = cut_lineage(whole_numbers(vectors, id_col, vector_col, label_col))
    dealt, n_blocks = _dealt(rows, "key", "block", BLOCK_BYTES, LEAST_BLOCK_BYTES)
    kind = rows.schema["id"].dataType.simpleString()
    blocks = Blocks(cut_lineage(_packed(dealt, "block", ("id", "label", "vector"))), n_blocks, kind)
    anchors = rows.where(anchor).select(F.col("key").alias("anchor"), F.col("id").alias("own"), "label", "vector", "self")
    asked = anchors.withColumns(
        {"window": F.lit(0), "lo": F.lit(_NONE), "hi": F.lit(-(_NONE + 1)), "top": F.col("self"), "span": F.col("self")}
    )
    found = search(blocks, asked, True, positives, POSITIVE_LEVELS)
    # num * positive <= den * negative for whole numbers, without a product that may not fit.
    num, den = low
    chosen = found.where("score >= 0").select(
        F.col("anchor").alias("_anchor"),
        F.col("rank").alias("window"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("hi"),
        F.expr(f"score - score div {den} * {den - num} - score % {den} * {den - num} div {den}").alias("lo"),
    )
    windows = cut_lineage(
        anchors.join(chosen, F.col("anchor") == F.col("_anchor"))
        .withColumns({"top": F.col("hi"), "span": F.col("hi") - F.col("lo")})
        .drop("_anchor")
    )
    mined = search(blocks, windows, False, negatives, NEGATIVE_LEVELS)
    asked_for = windows.select(F.col("anchor").alias("_a"), F.col("window").alias("_w"), "own", "positive_id", "hi")
    return mined.join(asked_for, (F.col("anchor") == F.col("_a")) & (F.col("window") == F.col("_w"))).select(
        F.col("own").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        F.col("hi").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
