"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

A token is a run of alphanumeric characters or of other visible ones. Features
of a text are its tokens, pairs of neighbouring tokens, and pairs of token
shapes (case, digits, punctuation, whether a token repeats the one before),
each hashed to one of 2^BITS weights. A feature's value is its share of the
text's features, so a score does not depend on a text's length. Weights are
learnt by follow-the-regularised-leader with per-coordinate rates and an L1
term (McMahan et al., 2013) and stay sparse.

Scoring is one pass without a shuffle. Training reads a bounded sample of
labelled rows (`max_rows`); only ids, labels and the sample's features are
moved for it, and one task goes through them in a fixed order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocheline.llm import text as tx
from ocheline.plans.storage import cut_lineage

BITS = 18
SCALE = 30.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
EPOCHS = 4
# The sample of labelled rows to learn from: the first so many by hash of id.
MAX_ROWS = 6_000
THRESHOLD = 0.3
FOLDS = 5

# Kinds of bytes in a token, or-ed together to its shape.
_KIND = np.full(256, 16, np.uint8)
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 4
_KIND[0x80:] = 8


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight numbers of all features, where each text's features end)."""
    inside = tx.ALNUM[data]
    a, b = tx.spans(inside, offsets), tx.spans(~inside & ~tx.SPACE[data], offsets)
    order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
    starts = np.concatenate([a[0], b[0]])[order]
    ends = np.concatenate([a[1], b[1]])[order]
    found = tx.Words(data, starts, ends, np.searchsorted(starts, offsets))
    n = len(starts)
    h = tx.word_hashes(found)
    if n:
        shape = np.bitwise_or.reduceat(_KIND[data], starts)
        # reduceat runs on to the next start; white space between adds only bit 16
        inner = shape & np.where(inside[starts], 15, 16).astype(np.uint8)
        title = (_KIND[data[starts]] == 2) & (inner != 2)
        size = np.minimum(ends - starts, 15).astype(np.uint64)
    else:
        inner, title, size = np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(0, np.uint64)
    shape = inner.astype(np.uint64) | (title.astype(np.uint64) << np.uint64(5))
    shape |= np.where(inner == 16, size, 0).astype(np.uint64) << np.uint64(6)
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    pair = np.zeros(n, np.uint64)
    pair[1:] = h[:-1]
    before = np.zeros(n, np.uint64)
    before[1:] = shape[:-1] + np.uint64(1)
    first = found.first[:-1][found.counts > 0]
    pair[first] = before[first] = 0
    same[first] = False
    pairs = tx.mixed(pair * np.uint64(3) + h)
    shapes = tx.mixed(
        (before << np.uint64(24)) | (shape << np.uint64(8)) | same.astype(np.uint64) | np.uint64(1 << 62)
    )
    every = np.stack([h, pairs, shapes], axis=1).ravel() >> np.uint64(64 - BITS)
    return every.astype(np.int32), found.first * 3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1; a text without tokens gets that of the bias alone."""
        where, ends = features(*tx.flat(column))
        sums = np.concatenate([[0.0], np.cumsum(self.weights[where])])
        counts = np.diff(ends)
        mean = (sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-(self.bias + SCALE * mean)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (weight numbers, values, label) in the order given."""
    size = (1 << BITS) + 1  # the last one is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    keep = np.full(size, L1)
    keep[-1] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * keep[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) > keep[i], w, 0.0)

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weights(np.arange(size))
    return Model(w[:-1], float(w[-1]))


def example(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's feature numbers as sparse (numbers, values), the bias last."""
    numbers, counts = np.unique(where, return_counts=True)
    values = SCALE * counts / max(1, len(where))
    return np.append(numbers, 1 << BITS), np.append(values, 1.0)


def fold(id_col: str) -> F.Column:
    """crc32 of the id's text modulo FOLDS; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Learn from the labelled rows whose fold is not 0.

    Rows without an id or a label, or with a label other than 0 and 1, are left
    out; a repeated id is learnt once, with its smallest label and text hash.
    Beyond `max_rows` ids those with the smallest hashes are taken. Without
    any row to learn from the model is all zero and every score is 0.5.
    """
    wanted = (
        labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # At most max_rows ids and labels: broadcast whatever the size of the corpus.
    chosen = texts.join(F.broadcast(cut_lineage(wanted)), "_id").select("_id", "_y", "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, "_text"):
            where, ends = features(*tx.flat(part.column("_text")))
            parts = [where[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_y"), pa.array(parts, pa.binary())],
                ["id", "y", "where"],
            )

    kind = chosen.schema["_id"].dataType.simpleString()
    sample = cut_lineage(chosen.mapInArrow(extract, f"id {kind}, y int, where binary"))

    def learn(table: pa.Table) -> pa.Table:
        ids, ys = table.column("id").to_pylist(), table.column("y").to_pylist()
        raw = table.column("where")
        order = sorted(
            range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), str(ids[k]), raw[k].as_py())
        )
        rows, last = [], None
        for k in order:
            if ids[k] != last:
                rows.append((*example(np.frombuffer(raw[k].as_py(), np.int32)), ys[k]))
            last = ids[k]
        model = fit(rows)
        return pa.table({"weights": pa.array([model.weights.tobytes()]), "bias": [model.bias]})

    learnt = sample.groupBy().applyInArrow(learn, "weights binary, bias double").collect()
    if not learnt:
        return Model(np.zeros(1 << BITS), 0.0)
    return Model(np.frombuffer(learnt[0]["weights"], np.float64), learnt[0]["bias"])


def with_score(
    docs: DataFrame, model: Model, score_col: str = "score", text_col: str = "text"
) -> DataFrame:
    """`docs` with the model's score of each whole text; an existing `score_col` is replaced.

    Null, empty and unknown texts are scored by the bias alone.
    """
    rest = docs.drop(score_col)
    sent = rest.sparkSession.sparkContext.broadcast(model)  # 2^BITS doubles, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.pieces(batches, text_col):
            scores = sent.value.scores(part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(scores)], [*part.schema.names, score_col]
            )

    schema = T.StructType([*rest.schema.fields, T.StructField(score_col, T.DoubleType())])
    return rest.mapInArrow(run, schema)


def predicted(score: F.Column) -> F.Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0)
