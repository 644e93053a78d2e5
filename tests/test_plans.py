"""Plans that have to hold at scale, and steps that cut lineage."""

import contextlib
import io
import os
import re

import make
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ocheline.operators import games
from ocheline.plans import joins, ordered, storage
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tables_of_a_session_can_be_removed(spark):
    kept = storage.cut_lineage(spark.range(3))
    assert kept.count() == 3 and storage.session_folder(spark) in kept.inputFiles()[0]
    storage.remove_tables(spark)
    assert not os.path.exists(storage.session_folder(spark))


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_even_without_broadcast(spark, no_broadcast, name):
    text = plan(driver.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


ONE_SHUFFLE = ["w2_detect_throws", "j2_asof_calibration", "g12_dedupe_throws", "w1_sample_frames"]
# One besides those of the corrections these queries resolve first.
ONE_MORE = ["w3_assign_turns", "w4_running_score", "w6_cricket_points", "g3_turn_totals", "j8_close_groupings"]
NO_SHUFFLE = ["m4_map_segment", "m5_score", "m6_to_notation", "p1_validate_throws", "p4_route_confidence", "p6_assemble_throws", "p7_to_adapter", "j6_ring_lookup", "s8_union_sources"]


def shuffles(spark, name):
    return len(re.findall(r"\bExchange (hash|range|Single)", plan(driver.queries()[name](spark, SF))))


@pytest.mark.parametrize("name", ONE_SHUFFLE + NO_SHUFFLE)
def test_shuffles(spark, name):
    assert shuffles(spark, name) == (1 if name in ONE_SHUFFLE else 0)


@pytest.mark.parametrize("name", ONE_MORE)
def test_shuffles_after_corrections(spark, name):
    assert shuffles(spark, name) == 1 + shuffles(spark, "r2_effective_throws")


@pytest.mark.parametrize("name", ["g12_dedupe_throws", "w1_sample_frames"])
def test_groups_are_limited_before_the_shuffle(spark, name):
    text = plan(driver.queries()[name](spark, SF))
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_what_is_needed(spark):
    text = plan(driver.queries()["g10_calibration_friction"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in text
    text = plan(driver.queries()["m5_score"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_over_large_groups_are_cut(spark, hot):
    rows = [make.throw(i, "S1", player="ab"[i % 2]) for i in range(50)] + [make.throw(100, "S1", session="t")]
    cold, large = ordered.split_hot(make.table(spark, rows), ["session_id"], games.ORDER)
    assert cold.count() == 1 and large.count() == 50
    sizes = large.groupBy(ordered.CHUNK).agg(F.count("*").alias("n"), F.min("captured_at").alias("lo"), F.max("captured_at").alias("hi"))
    chunks = sizes.orderBy(ordered.CHUNK).collect()
    assert len(chunks) > 5 and max(c.n for c in chunks) < 25
    assert all(a.hi < b.lo for a, b in zip(chunks, chunks[1:]))


@pytest.mark.parametrize("large", [False, True])
def test_running_values(spark, request, large):
    if large:
        request.getfixturevalue("hot")
    values = [(k, i, None if i % 3 == 0 else (i * 7) % 11) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(values, "k string, i int, v int")
    steps = {
        "total": ordered.total(F.col("v")),
        "peak": ordered.peak(F.col("v")),
        "latest": ordered.latest(F.col("v")),
        "previous": ordered.previous(F.col("v")),
    }
    found = ordered.over_groups(df, ["k"], ["i"], lambda d: ordered.running(d, ["k"], ["i"], steps))
    for k in ("a", None):
        seen = []
        for r in sorted((r for r in found.collect() if r.k == k), key=lambda r: r.i):
            before = seen[-1] if seen else None
            seen.append(r.v)
            known = [v for v in seen if v is not None]
            assert (r.total, r.peak) == (sum(known), max(known, default=None))
            assert (r.latest, r.previous) == (known[-1] if known else None, before)
        assert len(seen) == 30


def test_lineage_goes_to_the_named_folder(spark, tmp_path):
    own = storage.session_folder(spark)
    assert own.startswith(spark.conf.get(storage.SETTING))
    before = set(os.listdir(own)) if os.path.isdir(own) else set()
    cut = storage.cut_lineage(spark.range(5))
    assert cut.count() == 5 and "FileScan parquet" in plan(cut)
    assert len(set(os.listdir(own)) - before) == 1


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_sizes_are_read_from_the_uncorrected_throws(spark):
    """What makes the frames evaluates nothing of the corrected throws."""
    raw = make.table(spark, [make.throw(i, "S20") for i in range(8)])
    costly = raw.drop("correction_of").withColumn("score", F.raise_error(F.lit("evaluated")).cast("int"))
    costly = costly.withColumn("session_id", F.when(F.raise_error(F.lit("evaluated")).isNull(), F.col("session_id")))
    for made in (
        games.assign_turns(costly, raw),
        games.running_score(costly, raw),
        games.cricket_marks(costly, counted=raw),
        games.cricket_points(costly, counted=raw),
        games.cricket_standings(costly, counted=raw),
    ):
        with pytest.raises(Exception, match="evaluated"):
            made.collect()


@pytest.mark.parametrize("most", [0, 100_000_000])
@pytest.mark.parametrize("limit", [None, "5"])
def test_intervals_of_any_width(spark, most, limit):
    """Widths of one cell and of a million: each fact finds all that hold it, or none."""
    rng = __import__("random").Random(5)
    spans = [(i, lo, lo + w) for i in range(60) for lo, w in [(rng.uniform(-50, 50), rng.choice([0.0, 0.3, 1.0, 7.0, 40.0]))]]
    spans += [(100, -5e5, 5e5), (101, 3.0, None), (102, None, 4.0), (103, 5.0, 4.0)]
    facts = [(i, rng.choice([rng.uniform(-60, 60), 3.0, 4e5, 6e5, None])) for i in range(120)] + [(7, 3.0), (7, 3.0)]
    if limit:
        spark.conf.set(ordered.LIMIT_SETTING, limit)
    try:
        found = joins.interval_lookup(
            spark.createDataFrame(facts, "k int, v double"), F.col("v"),
            spark.createDataFrame(spans, "name int, lo double, hi double"), "lo", "hi", 1.0, most,
        ).collect()
    finally:
        spark.conf.unset(ordered.LIMIT_SETTING)
    want = []
    for k, v in facts:
        hits = [n for n, lo, hi in spans if None not in (v, lo, hi) and lo <= v < hi]
        want += [(k, v, n) for n in hits or [None]]
    key = lambda r: str(r)
    assert sorted(((r.k, r.v, r.name) for r in found), key=key) == sorted(want, key=key)


def test_rows_of_wide_intervals_follow_their_number(spark):
    cells = joins._cells(spark.createDataFrame([(k * 1.0, k + 1e6) for k in range(50)], "lo double, hi double"), "lo", "hi", 2.0**20)
    assert cells.count() <= 150


def test_equal_runs_are_not_compared_row_by_row(spark):
    rows = [(i, i % 7, float(i)) for i in range(500)] * 2
    a = spark.createDataFrame(rows, "k int, m int, v double")
    b = spark.createDataFrame(rows[::-1], "k int, m int, v double").select("v", "k", "m").repartition(5)
    same = games.replay_diff(a, b)
    assert same.count() == 0 and "ExceptAll" not in same._jdf.queryExecution().logical().toString()
    other = spark.createDataFrame([*rows[1:], (7, 7, None)], "k int, m int, v double")
    found = games.replay_diff(a, other, games.run_digest(a), games.run_digest(other))
    assert sorted((r.k, r.v, r.only_in) for r in found.collect()) == [(0, 0.0, "a"), (7, None, "b")]
    assert games.replay_diff(a.limit(0), a.limit(0)).count() == 0
