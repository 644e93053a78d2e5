"""Compare a Spark result with SQL, whatever the order of rows and columns."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def kind(name: str) -> str:
    """Column type under one name for both engines."""
    name = name.upper()
    same = {
        "STRING": "VARCHAR", "INT": "INTEGER", "TIMESTAMP_NTZ": "TIMESTAMP", "LONG": "BIGINT",
    }
    return same.get(name, name)


def spark_rows(df):
    names = sorted(df.columns)
    types = [kind(df.schema[c].dataType.simpleString()) for c in names]
    return names, types, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql: str):
    result = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    places = sorted(range(len(columns)), key=lambda i: columns[i][0])
    names = [columns[i][0] for i in places]
    types = [kind(columns[i][1]) for i in places]
    rows = Counter(tuple(plain(r[i]) for i in places) for r in result.fetchall())
    return names, types, rows
