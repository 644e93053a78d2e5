"""Near-duplicate texts against all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from ocheline.llm import near_texts


def edited(n, seed):
    """Texts of their own, edited copies of them and copies of copies, and some of few words."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = []
    for k in range(n):
        if texts and k % 3:
            words = draw.choice(texts).split()
            for _ in range(draw.randrange(0, 8)):
                if words:
                    words[draw.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(draw.choice([3, 5, 60, 120, 300]))]
        texts.append(" ".join(words))
    return list(enumerate([*texts, "", None, " \t"]))


@pytest.mark.parametrize("tile", [512, 4])
def test_edited_copies_go(spark, monkeypatch, tile):
    monkeypatch.setattr(near_texts, "TILE", tile)
    rows = edited(240, 5)
    want = plain.near_texts(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_texts.near_groups(df).collect()} == want
    kept = {r["doc_id"] for r in near_texts.keep_first(df).collect()}
    assert kept == {i for i, root in want.items() if i == root}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_given_documents(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = plain.near_texts_by_prefix(rows)
    if sf == "0.001":
        assert want == plain.near_texts(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_texts.near_groups(df).collect()} == want


def test_links_of_a_bucket_against_all_pairs():
    draw = random.Random(9)
    for _ in range(60):
        whole = draw.sample(range(10**6), 40)
        sets = [sorted(set(whole[: draw.choice([0, 1, 20, 36, 40])]) ^ set(draw.sample(whole, 2))) for _ in range(14)]
        sets.append([])
        group = np.array([draw.randrange(20) for _ in sets])
        i, j = near_texts.bucket_links([np.array(s, np.uint64).tobytes() for s in sets], group)
        ids = range(len(sets))
        same = [(a, b) for a in ids for b in ids if a < b and group[a] == group[b]]
        near = [
            (a, b)
            for a in ids
            for b in ids
            if a < b and 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))
        ]
        assert plain.roots(ids, [*same, *zip(i.tolist(), j.tolist())]) == plain.roots(ids, same + near)
