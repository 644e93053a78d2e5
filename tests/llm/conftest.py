import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Rows that trouble: nulls, empty and blank texts, repeats, one long text.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It sleeps"),
    (2, "the quick BROWN fox jumps over the lazy dog. it sleeps"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, "Ünïcode … 日本語 😀 x\x0by\x0cz"),
    (8, LONG + " tail"),
    (9, "one two"),
    (9, "one two"),
    (None, "one two"),
    (None, None),
]


@pytest.fixture(scope="session")
def messy(spark):
    """(rows, frame): trouble, with extra columns of names the operators use inside."""
    extra = "id text fp part hash score _hits _spans piece_ids shard host _id _row"
    names = [n for n in extra.split() if n not in ("text",)]
    rows = [(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return TEXTS, spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


@pytest.fixture(scope="session")
def rows():
    return rows_of
