"""Hard negatives against all scores in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ocheline.llm import negatives as hn

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def first(rows, most):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:most]


def plain(rows, every):
    usable = []
    for id_, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if max(map(abs, whole), default=0) < 2**31 and sum(x * x for x in whole) <= 2**62:
            usable.append((id_, whole, label))
    out = []
    for a_id, a, a_label in usable:
        if a_id is None or a_id % every:
            continue
        scores = [
            (sum(x * y for x, y in zip(a, b)), b_id, b_label == a_label)
            for b_id, b, b_label in usable
            if b_id != a_id and len(a) == len(b)
        ]
        for p, p_id, _ in first([s for s in scores if s[2]], 5):
            fits = [s for s in scores if not s[2] and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(a_id, p_id, k + 1, n_id, p, n) for k, (n, n_id, _) in enumerate(first(fits, 5))]
    return sorted(out, key=str)


def mined(spark, rows, every=10, kind="array<double>"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)
    found = hn.hard_negatives(frame, F.col("id") % every == 0)
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("seed,size,spread", [(1, 24, 0.3), (2, 5, 1.0), (3, 40, 0.05)])
def test_against_all_pairs(spark, monkeypatch, seed, size, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, size))
    rows = []
    for i in range(240):
        v = centres[i % 6] + spread * rnd.normal(size=size)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rnd.integers(0, 4))))
    rows += [(1000 + i, rows[i][1], (i * 7) % 4) for i in range(0, 60, 3)]  # equal vectors, other labels
    monkeypatch.setattr(hn, "BLOCK_BYTES", 6_000)
    monkeypatch.setattr(hn, "CELLS", 500)
    want = plain(rows, 10)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_few_rows_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 1), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 1),
        (5, [0.95, 0.0], 2), (6, [0.95, 5.0], 3), (7, [0.8, 0.0], 2), (8, [0.1, 0.0], 2), (9, [0.0, 2.0], 2),
        (10, None, 1), (11, [1.0, None], 2), (12, [nan, 1.0], 2), (13, [inf, 1.0], 2), (14, [1.0, 0.0], None),
        (15, [1.0], 2), (16, [], 2), (20, [], 1), (21, [], 2), (22, [], 1), (None, [0.95, 0.0], 2), (None, [1.0, 0.0], 1),
        (30, [1e300, 1.0], 1), (31, [3e6, 0.0], 2), (0, [0.5, 0.0], 1), (1, [1.0, 0.0], 1), (0, [0.9, 0.0], 2),
        (40, [0.0, 0.0], 1), (41, [0.0, 0.0], 3),
    ]
    assert mined(spark, rows) == plain(rows, 10)


def test_large_numbers_are_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-8e6, 8e6) for _ in range(4)], i % 3) for i in range(60)]
    want = plain(rows, 10)
    assert want and max(abs(r[4]) for r in want) > 2**53
    assert mined(spark, rows) == want


def test_floats_and_clashing_columns(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=6).astype(np.float32).tolist(), i % 2) for i in range(80)]
    want = plain(rows, 10)
    assert mined(spark, rows, kind="array<float>") == want
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clash = frame.withColumns({c: F.lit("x") for c in ("id", "key", "block", "vector", "window", "rank", "anchor", "own")})
    found = hn.hard_negatives(clash, F.col("id") % 10 == 0)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == want


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_index_finds_what_reaches_the_threshold():
    rnd = np.random.default_rng(5)
    rows = np.floor(256 * rnd.normal(size=(300, 30))).astype(np.int64)
    anchors = np.floor(256 * rnd.normal(size=(7, 30))).astype(np.int64)
    scores = anchors @ rows.T
    for share in (0.9, 0.5, 0.1, -2.0):
        least = np.floor(share * np.square(anchors).sum(axis=1))
        got = {(int(i), int(j), int(s)) for a, b, c in hn.Index(rows, anchors).pairs(least) for i, j, s in zip(a, b, c)}
        assert got == {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= least[:, None]))}


def test_index_omits_covered_dimensions(monkeypatch):
    """A row whose norm is too small is never posted; so wrong suffix norms lose pairs."""
    rows = np.array([[10] * 16, [1000] * 16], np.int64)
    anchors = np.array([[100] * 16], np.int64)
    index = hn.Index(rows, anchors)
    index.rows[0] = 10**6  # never read, for its norm says that it cannot reach the threshold
    (found,) = index.pairs(np.array([1_000_000.0]))
    assert found[1].tolist() == [1]
    index.row_norms[:] = 0
    (found,) = index.pairs(np.array([1_000_000.0]))
    assert found[1].tolist() == []


def test_best_handles_null_ids_and_order():
    rows = pa.RecordBatch.from_pydict({
        "id": pa.array([None, 5, 3, 9], pa.int64()), "label": pa.array([2, 2, 2, 1]),
        "vector": pa.array([[2], [2], [2], [2]], pa.list_(pa.int64())),
    })
    asked = pa.RecordBatch.from_pydict({
        "anchor": [7], "own": [9], "label": [1], "vector": pa.array([[1]], pa.list_(pa.int64())),
        "window": pa.array([0], pa.int32()), "hi": [2], "least": [2],
    })
    assert hn.best(rows, asked, False, 5).column("id").to_pylist() == [3, 5, None]
    assert hn.best(rows, asked, True, 5).num_rows == 0
