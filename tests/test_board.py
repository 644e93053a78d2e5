"""Board geometry, notation, checks."""

import math

import make
import pytest
from pyspark.sql import functions as F

from ocheline.operators import board, events
from ocheline.plans import joins
from ocheline.schemas import WEDGES

RINGS = [6.35, 15.9, 99.0, 107.0, 162.0, 170.0]
RESULTS = [(25, 2), (25, 1), (None, 1), (None, 3), (None, 1), (None, 2), (0, 0)]


def polar(mm, degrees):
    a = math.radians(degrees)
    return mm / 170 * math.sin(a), mm / 170 * math.cos(a)


def mapped(spark, points, spec=None):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    found = board.map_segment(df, spec).orderBy("i").collect()
    return [(r["segment"], r["multiplier"]) for r in found]


CASES = [((0.0, 0.0), (25, 2)), ((3.0, 0.0), (0, 0)), ((0.0, 1.0), (0, 0))]
for ring, edge in enumerate(RINGS):
    for step in (-1e-6, 1e-6):
        segment, multiplier = RESULTS[ring if step < 0 else ring + 1]
        CASES.append((polar(edge + step, 0), (20 if segment is None else segment, multiplier)))
for place, number in enumerate(WEDGES):
    CASES.append((polar(50, 18 * place), (number, 1)))
    CASES.append((polar(103, 18 * place + 8.999), (number, 3)))
    CASES.append((polar(166, 18 * place - 8.999), (number, 2)))
# x = y is the wire between two wedges, at 45 degrees: it belongs to the next one.
CASES += [((0.2, 0.2), (4, 1)), ((0.2, -0.2), (15, 1)), ((-0.2, -0.2), (16, 1)), ((-0.2, 0.2), (9, 1))]


def wire(x, y):
    return WEDGES[int((math.degrees(math.atan2(x, y)) + 369) % 360 // 18)]


@pytest.mark.parametrize("by_table", [False, True])
def test_segments(spark, by_table):
    spec = board.board_spec(spark) if by_table else None
    found = mapped(spark, [p for p, _ in CASES], spec)
    expected = [
        (wire(*p), 1) if abs(p[0]) == abs(p[1]) == 0.2 else r for p, r in CASES
    ]
    assert found == expected


def test_ring_edges_are_half_open(spark):
    for ring, edge in enumerate(RINGS):
        segment, multiplier = RESULTS[ring + 1]
        assert mapped(spark, [(0.0, edge / 170)]) == [(20 if segment is None else segment, multiplier)]
        assert mapped(spark, [(0.0, edge / 170)], board.board_spec(spark)) == mapped(
            spark, [(0.0, edge / 170)]
        )


def test_no_point_no_segment(spark):
    df = spark.createDataFrame([(None, 0.1)], "x double, y double")
    assert board.map_segment(df).first()["segment"] is None
    assert board.map_segment(df, board.board_spec(spark)).first()["segment"] is None


def test_crowded_cells_of_a_large_ring_table(spark, monkeypatch, hot):
    monkeypatch.setattr(joins.interval_lookup, "__defaults__", (0,))
    points = [p for p, _ in CASES] * 9
    assert mapped(spark, points, board.board_spec(spark)) == mapped(spark, points)


def test_ring_table_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins.interval_lookup, "__defaults__", (0,))
    points = [p for p, _ in CASES]
    spec = board.board_spec(spark)
    assert mapped(spark, points, spec) == mapped(spark, points)


LEGAL = [(0, 0), (25, 1), (25, 2)] + [(s, m) for s in range(1, 21) for m in (1, 2, 3)]


def test_notation_there_and_back(spark):
    df = spark.createDataFrame(LEGAL, "segment int, multiplier int")
    both = df.withColumnsRenamed({"segment": "s", "multiplier": "m"}).withColumns(
        {"segment": F.col("s"), "multiplier": F.col("m")}
    )
    back = board.from_notation(board.to_notation(both)).collect()
    assert len(back) == 63
    assert all((r.s, r.m) == (r.segment, r.multiplier) for r in back)
    assert {r.notation for r in back} == {make.notation(*p) for p in LEGAL}
    assert all(r.score == r.s * r.m for r in board.with_score(df.withColumns({"s": F.col("segment"), "m": F.col("multiplier")})).collect())


def test_notation_of_nothing(spark):
    bad = ["T25", "S21", "D0", "", "t20", "D05", "MISS ", "SB2", None]
    df = spark.createDataFrame([(b,) for b in bad], "notation string")
    assert all(r.segment is None and r.multiplier is None for r in board.from_notation(df).collect())
    odd = spark.createDataFrame([(25, 3), (21, 1), (5, 0), (0, 1)], "segment int, multiplier int")
    assert [r.notation for r in board.to_notation(odd).collect()] == [None] * 4


def test_each_rule(spark):
    nan = float("nan")
    cases = [
        ({}, []),
        ({"session_id": None}, ["session_id"]),
        ({"captured_at": None}, ["captured_at"]),
        ({"x": nan}, ["impact"]),
        ({"y": float("inf")}, ["impact"]),
        ({"segment": 21, "score": 63}, ["segment", "multiplier", "notation"]),
        ({"multiplier": 4, "score": 80}, ["multiplier", "notation"]),
        ({"score": 59}, ["score"]),
        ({"notation": "D20"}, ["notation"]),
        ({"confidence": 1.5}, ["confidence"]),
        ({"confidence": None}, ["confidence"]),
        ({"calibration_id": None}, ["calibration_id"]),
        ({"source": "robot"}, ["source"]),
        ({"correction_of": "7"}, ["correction_of"]),
        ({"source": "manual-correction"}, ["correction_of"]),
        ({"x": None, "confidence": -1.0, "source": None}, ["impact", "confidence", "source", "correction_of"]),
        ({"segment": 25, "multiplier": 3, "score": 75, "notation": "T25"}, ["multiplier", "notation"]),
    ]
    rows = [make.throw(i, "T20", **change) for i, (change, _) in enumerate(cases)]
    found = {r.id: r.violations for r in events.validate_throws(make.table(spark, rows)).collect()}
    assert found == {str(i): broken for i, (_, broken) in enumerate(cases)}
    good, bad = events.split_valid(make.table(spark, rows))
    assert (good.count(), bad.count()) == (1, len(cases) - 1)


def test_dedupe_keeps_the_first(spark):
    rows = [
        make.throw(1, "T20", second=5),
        make.throw(1, "S5", second=3),
        make.throw(1, "S5", second=3),
        make.throw(2, "S1"),
    ]
    found = {r.id: r.notation for r in events.dedupe_throws(make.table(spark, rows)).collect()}
    assert found == {"1": "S5", "2": "S1"}


def test_vendor_fields(spark):
    rows = [('{"id":"1","boardX":2,"app":{"a":1}}',), ('{"id":"2","impact":{}}',), ("not json",)]
    df = spark.createDataFrame(rows, "raw string")
    assert [r.leaked for r in events.vendor_leak(df, "raw").collect()] == [["app", "boardX"]]


def test_grants_include_their_ends(spark):
    t = make.table(spark, [make.throw(i, second=i) for i in range(5)])
    grants = spark.createDataFrame(
        [("a", "s", make.at(1), make.at(3)), ("a", "s", make.at(2), make.at(3)), ("b", "s", make.at(0), make.at(9))],
        "adapter string, session_id string, valid_from timestamp, valid_to timestamp",
    )
    assert sorted(r.id for r in events.authorised(t, grants, "a").collect()) == ["1", "2", "3"]
    assert events.authorised(t, grants).count() == 5


def test_unknown_licence_is_not_usable(spark):
    cat = spark.createDataFrame([("x", "mit"), ("y", "nc"), ("z", "?"), ("w", None)], "dataset string, licence string")
    lic = spark.createDataFrame([("mit", True), ("nc", False), (None, True)], "licence string, commercial boolean")
    assert [r.dataset for r in events.usable_datasets(cat, lic).collect()] == ["x"]


def test_mapping_of_an_unknown_column(spark):
    t = make.table(spark, [make.throw(1)])
    mapping = spark.createDataFrame([("x", "scoer", "points")], "adapter string, canonical string, vendor string")
    with pytest.raises(ValueError, match="scoer"):
        events.to_adapter(t, mapping, "x")


def test_vendor_fields_inside_objects(spark):
    raw = spark.createDataFrame([('{"id":"1","impact":{"xNormalized":1,"vendorTip":2},"detected":{"score":1}}',), ('{"impact":null}',)], "raw string")
    assert [r.leaked for r in events.vendor_leak(raw, "raw").collect()] == [["impact.vendorTip"]]


def test_columns_below_are_not_put_into_the_filters_of_split_valid(spark):
    points = spark.range(50).selectExpr(
        "cast(id AS string) AS id", "'s' AS session_id", "timestamp'2024-01-01' AS captured_at",
        "id / 40D AS x", "0.1D AS y", "if(id = 7, 2D, 0.5D) AS confidence", "'c' AS calibration_id",
        "'camera' AS source", "cast(NULL AS string) AS correction_of",
    )
    throws = board.to_notation(board.with_score(board.map_segment(points)))
    good, bad = events.split_valid(throws)
    assert good.count() == 49 and [r["violations"] for r in bad.collect()] == [["confidence"]]

    def atan2s(df):
        return df._jdf.queryExecution().optimizedPlan().toString().upper().count("ATAN2")

    assert 0 < atan2s(good) == atan2s(bad) == atan2s(throws)
