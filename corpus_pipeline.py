"""From raw documents to encoded text in five stages, each written and read again.

Every stage works on all rows its predecessor kept. All but the last return the
columns of `documents`; the last adds the ids of the text's pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import ocheline
from ocheline.llm import frames, ftrl, near_texts, queries, secrets, unigram, vptree, wu_manber
from ocheline.plans.storage import session_folder

# The Python functions that run in tasks travel with them.
cloudpickle.register_pickle_by_value(ocheline)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier predicts to be of quality 0."""
    model = ftrl.train(docs, queries.table(spark, sf_dir, "labels"))
    name = frames.unused(docs, "_quality")
    scored = ftrl.with_score(docs, model, name)
    return scored.where(ftrl.predicted(scored[name]) == 1).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.

    A group is what the links of `op8` connect, SimHashes within its two bits found
    by the vantage-point tree, and those of texts of five-word similarity 0.8 or
    more, which differ by more bits than the tree can search.
    """
    return near_texts.keep_first(docs, also=vptree.near_links)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return wu_manber.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put secrets out of the texts; no document goes."""
    return secrets.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of each text's pieces; decoded they spell the text."""
    return unigram.with_ids(docs, unigram.load(queries.PIECES))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

# Learning, fingerprints and encoding are beyond SQL; tests hold the rows
# against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents in `sf_dir`."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{session_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
