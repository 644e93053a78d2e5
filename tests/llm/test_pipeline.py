"""The pipeline against plain Python, stage by stage."""

from __future__ import annotations

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ocheline.llm import ftrl, queries, unigram

SF = "/root/testdata/sf0.001"


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def test_run_against_plain_python(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.columns == [*docs.columns, "piece_ids"]
    model = ftrl.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in ftrl.with_score(docs, model).collect()}
    texts = dict(table(spark, "documents", "doc_id", "text"))
    rows = [(i, t) for i, t in texts.items() if scores[i] >= 0.3]
    groups = plain.near_texts(rows)
    rows = [(i, t) for i, t in rows if groups[i] == i]
    hits = plain.contamination(rows, table(spark, "benchmark", "item_id", "text"))
    rows = [(i, plain.redacted(t)) for (i, t), h in zip(rows, hits) if not h[-1]]
    found = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["text"] for i, r in found.items()} == dict(rows)
    decoded = unigram.with_text(got, unigram.load(queries.PIECES))
    assert all(r["decoded"] == r["text"] for r in decoded.collect())
    # Clean documents stay, those of quality 0 go.
    labels = dict(table(spark, "labels", "doc_id", "quality"))
    assert sum(scores[i] < 0.3 for i, q in labels.items() if q == 1 and i in scores) == 0


def test_names_used_inside_may_be_columns(spark, messy):
    df = messy[1].withColumns({c: F.col("id") for c in ("_quality", "_kept_id", "_key", "component_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert set(df.columns) <= set(out.columns) and out.count() > 0, name


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_in_trouble(spark, messy, none, name, stage):
    last = corpus_pipeline.STAGES[-1][0]
    for df, most in ((messy[1], len(messy[0])), (none, 0)):
        out = stage(spark, df, SF)
        own = [c for c in df.columns if c != "piece_ids"] + ["piece_ids"]
        assert out.columns == (own if name == last else df.columns)
        assert out.count() <= most


def test_near_duplicates_include_those_of_the_tree(spark):
    """One changed word at the end of many equal ones: equal fingerprints, a five-word similarity of a half."""
    same, other = " ".join(["mill"] * 40), "a tree finds prints that differ by two bits"
    docs = spark.createDataFrame([(3, f"{same} stone"), (2, same), (1, other)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
