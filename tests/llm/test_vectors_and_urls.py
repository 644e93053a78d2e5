"""Vectors against all pairs, hosts against dense PageRank, components against union-find."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import plain
import pytest
from pyspark.sql import functions as F

from ocheline.llm import pstable, queries, url_trust
from ocheline.llm.components import components


def brute(rows):
    """{position: (n_links, positions of the component)}."""
    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [k for k, (_, v, label) in enumerate(rows) if usable(v, label)]
    links = []
    for a in good:
        for b in good:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links.append((a, b))
    found = plain.roots(range(len(rows)), links)
    counts = [sum(k in pair for pair in links) for k in range(len(rows))]
    return counts, found


def vectors(n, seed):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = draw.normal(size=16) * draw.uniform(0.1, 100)
        if rows and k % 3:
            near = np.array(rows[draw.integers(len(rows))][1])
            if len(near) == 16 and np.isfinite(near).all():
                v = near + draw.normal(size=16) * np.linalg.norm(near) * draw.choice([0.0, 0.01, 0.05])
        rows.append((k, v.tolist(), int(draw.integers(2))))
    return rows


@pytest.mark.parametrize("tile", [2048, 8])
def test_vectors_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(pstable, "TILE", tile)
    rows = vectors(160, 2048)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    counts, found = brute(rows)
    got = {r["vec_id"]: r for r in pstable.near_vectors(df).collect()}
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"]) == (counts[k], found[k])
        assert got[k]["kept"] == (found[k] == k)


def test_vectors_in_trouble(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [1.0, 2.0], None), (4, None, 0), (5, [], 0),
        (6, [0.0, 0.0], 0), (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, None], 0),
        (10, [2e300, 4e300], 0), (11, [1.0, 2.0, 0.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0),
        (None, [5.0, -1.0], 0), (12, [1.0, 2.0], 1), (13, [-1.0, -2.0], 0),
    ]
    df = spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, key string, links string"
    )
    got = pstable.near_vectors(df).collect()
    linked = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got if r["n_links"])
    assert linked == [(0, 4, 1), (1, 4, 1), (2, 4, 1), (2, 4, 1), (10, 4, 1)]
    assert len(got) == len(rows) and all(r["kept"] is not None for r in got)
    assert pstable.near_vectors(df.limit(0)).collect() == []


def test_recall_of_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    truth = ((v @ v.T >= 0.93) & (label[:, None] == label[None])).sum(axis=1) - 1
    found = sum(r["n_links"] for r in pstable.near_vectors(df).collect())
    assert 0.9 * truth.sum() <= found <= truth.sum()


def test_components_of_chains_stars_and_random_graphs(spark):
    random.seed(8)
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)]
    edges += [(random.randrange(2000, 2600), random.randrange(2000, 2600)) for _ in range(350)]
    edges += [(5, 5), (None, 7), (6, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    real = [e for e in edges if None not in e]
    want = plain.roots({x for e in real for x in e}, real)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0)).collect() == []


URLS = [
    (1, "http://A.Example.org/es/x?q", ""), (2, "https://example.org/en/12#a", None),
    (3, "https://notexample.org/es/", ""), (4, "x://sub.shop.com/fr/a", "<a href='https://bad.net/'>"),
    (5, "http://shop.com/de/", ""), (6, "http://shop.com", ""), (7, None, "x"), (8, "", ""),
    (9, "no scheme/at all", ""), (10, "http://", ""), (11, "http://bad.net/?x=/de/", "<a href=//shop.com/de/1>"),
    (12, "a://b://c/de/", ""), (13, "http://farm.net/x", '<a href="http://evil.com/de/">' * 3),
    (14, "http://evil.com/de/a", ""), (14, "http://evil.com/de/a", ""), (15, "http://éé.org/\n/x", ""),
]


def test_urls_in_trouble(spark):
    df = spark.createDataFrame(
        [(*r, "h", "v", "x") for r in URLS],
        "page_id long, url string, html string, host string, verdict string, _h string",
    )
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in [
        {**r.asDict(), "rule": r["rule"] or ""} for r in url_trust.judge(df).collect()
    ])
    assert got[:4] == [
        (1, "a.example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "notexample.org", "/es/", "org/", "allow"),
        (4, "sub.shop.com", "/fr/a", "com/fr/", "allow"),
    ]
    by = {g[0]: g for g in got}
    assert by[6][1:] == ("shop.com", "", "", by[6][4])
    assert [by[k][1:] for k in (7, 8, 9)] == [("", "", "", "allow")] * 3
    assert by[10][1:3] == ("", "") and by[12][1:3] == ("b:", "//c/de/")
    assert by[13][4] == "block"  # it links to a blocked host only
    assert len(got) == len(URLS) and by[15][2] == "/\n/x"
    assert url_trust.judge(df.limit(0)).collect() == []


def test_spread_against_dense_matrix(spark):
    draw = np.random.default_rng(4)
    n = 12
    links = draw.integers(0, 3, (n, n)) * (draw.random((n, n)) < 0.3)
    np.fill_diagonal(links, 0)
    edges = [(f"h{a}", f"h{b}", int(links[a, b])) for a in range(n) for b in range(n) if links[a, b]]
    seeds = [("k", "h0", 3.0), ("k", "h5", 1.0), ("other", "h1", 7.0)]
    got = url_trust.spread(
        spark.createDataFrame([("k", *e) for e in edges] + [("other", "h1", "h2", 1)], "kind string, src string, dst string, n long"),
        spark.createDataFrame(seeds, "kind string, host string, weight double"),
    )
    every = {(r["kind"], r["host"]): r["score"] for r in got.collect()}
    assert every["other", "h1"] == pytest.approx(0.15) and every["other", "h2"] == pytest.approx(0.15 * 0.85)
    got = {h: s for (k, h), s in every.items() if k == "k"}
    step = links / np.maximum(links.sum(axis=1), 1)[:, None]
    start = np.zeros(n)
    start[[0, 5]] = 0.75, 0.25
    # The exact solution: what is left out after the rounds is below the tolerance.
    rank = np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * start)
    assert sum(abs(got.get(f"h{k}", 0.0) - rank[k]) for k in range(n)) < url_trust.TOLERANCE


def test_verdicts_do_not_hang_on_the_number_of_hosts(spark):
    rows = [(f"http://bad{k}.com/de/{j}", "") for k in range(3) for j in range(20)]
    rows += [("http://ads.net/x", '<a href="http://bad0.com/de/1">'), ("http://bad0.com/x", ""), ("http://calm.net/", "")]
    schema = "url string, html string, copy int"

    def verdicts(copies):
        many = [
            (u.replace(".", f"x{c}."), h.replace(".", f"x{c}."), c) for c in range(copies) for u, h in rows
        ]
        found = url_trust.judge(spark.createDataFrame(many, schema)).select("url", "copy", "verdict").collect()
        return {(r["url"].replace(f"x{r['copy']}.", "."), r["verdict"]) for r in found}

    once = verdicts(1)
    assert ("http://ads.net/x", "block") in once and ("http://calm.net/", "allow") in once
    assert verdicts(300) == once


def test_sql_and_code_agree_on_many_hosts(spark):
    """The given pages twenty times, each under hosts of their own."""
    import compare
    import duckdb

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").toPandas()
    copies = []
    for k in range(20):
        copy = pages.copy()
        copy["page_id"] += 10**6 * k
        copy["url"], copy["html"] = (copy[c].str.replace("://", f"://c{k}x", regex=False) for c in ("url", "html"))
        copies.append(copy)
    every = pd.concat(copies)
    found = url_trust.judge(spark.createDataFrame(every)).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.register("pages", every)
    assert compare.spark_rows(found) == compare.sql_rows(con, queries.ORACLES["op1_url_trust"])


def test_columns_may_have_the_names_used_inside(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/1", "")], "page_id int, url string, html string")
    clash = df.withColumns({c: F.lit(c) for c in ("_h", "_host", "_t", "_d", "kind", "score", "h", "v")})
    (row,) = url_trust.judge(clash).collect()
    assert (row["_host"], row["_t"], row["_d"], row["kind"], row["verdict"]) == ("_host", "_t", "_d", "kind", "block")


def test_url_filter_runs_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "Python" not in url_trust.judge(df)._jdf.queryExecution().toString()
