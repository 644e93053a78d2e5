"""X01, Cricket, turns: by hand and against a dart-by-dart walk."""

import datetime as dt
import random

import dart_by_dart as rules
import make
import pytest
from pyspark.sql import functions as F

from ocheline.operators import corrections, games


def x01(spark, whats, start=501, double_out=True, player="a", **kw):
    rows = [make.throw(i, w, player=player) for i, w in enumerate(whats)]
    t = make.table(spark, rows).drop("correction_of")
    states = games.x01_states(t, make.game(spark, "X01", start, double_out)).collect()
    return [(r.remaining, r.status) for r in sorted(states, key=lambda r: int(r.id))]


CASES = [
    (501, True, ["T20", "T20", "T20", "S1"], [(441, "scored"), (381, "scored"), (321, "scored"), (320, "scored")]),
    # below 0, on 1, on 0 without a double; first, second and third dart
    (40, True, ["T20", "S1", "S1", "D20"], [(40, "bust"), (40, "void"), (40, "void"), (0, "finish")]),
    (40, True, ["S20", "S19", "S1", "D20"], [(20, "scored"), (40, "bust"), (40, "void"), (0, "finish")]),
    (40, True, ["S10", "S10", "S20", "S2"], [(30, "scored"), (20, "scored"), (40, "bust"), (38, "scored")]),
    (50, True, ["DB", "S1"], [(0, "finish"), (None, "after")]),
    (25, False, ["SB", "S1"], [(0, "finish"), (None, "after")]),
    (2, False, ["S1", "S1"], [(1, "scored"), (0, "finish")]),
    (2, True, ["S1", "MISS", "MISS", "D1"], [(2, "bust"), (2, "void"), (2, "void"), (0, "finish")]),
]


@pytest.mark.parametrize("start,double_out,whats,expected", CASES)
def test_x01(spark, start, double_out, whats, expected):
    assert x01(spark, whats, start, double_out) == expected


def test_leg_is_over_for_all(spark):
    rows = [make.throw(0, "S1", player="a"), make.throw(1, "D20", player="b"), make.throw(2, "S5", player="a")]
    t = make.table(spark, rows).drop("correction_of")
    found = {r.id: (r.remaining, r.status) for r in games.x01_states(t, make.game(spark, start=40)).collect()}
    assert found == {"0": (39, "scored"), "1": (0, "finish"), "2": (None, "after")}


def test_correction_undoes_a_bust(spark):
    rows = [make.throw(0, "T20"), make.throw(1, "D10"), make.throw(2, "S20", of=0), make.throw(3, "S1")]
    t = make.table(spark, rows)
    g = make.game(spark, start=40)
    before = games.x01_states(t.filter("correction_of IS NULL").drop("correction_of"), g)
    after = games.x01_states(corrections.effective_throws(t), g)
    assert {r.id: r.status for r in before.collect()} == {"0": "bust", "1": "void", "3": "void"}
    assert {r.id: (r.remaining, r.status) for r in after.collect()} == {
        "0": (20, "scored"), "1": (0, "finish"), "3": (None, "after"),
    }


def test_given_turns(spark):
    rows = [make.throw(i, "S1", turn_id=u) for i, u in enumerate(["u", "u", "v", "v", "v", "v", None])]
    found = games.assign_turns(make.table(spark, rows)).orderBy("captured_at").collect()
    assert [(r.turn_no, r.dart_no) for r in found] == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def test_close_groupings(spark):
    spots = [(0.0, 0.0), (0.01, 0.0), (0.5, 0.5), (0.01, 0.0), (0.01, 0.01)]
    rows = [make.throw(i, x=x, y=y) for i, (x, y) in enumerate(spots)]
    found = games.close_groupings(games.assign_turns(make.table(spark, rows)), 0.05).collect()
    assert {(r.id, r.other_id) for r in found} == {("0", "1"), ("3", "4")}


def random_throws(rng, n, players=("a", "b", "c"), sessions=("s", "t")):
    pool = ["MISS", "SB", "DB", "S1", "S5", "T20", "T19", "S20", "D20", "D16", "S18", "T17", "T16", "T15", "T18"]
    return [
        make.throw(i, rng.choice(pool), player=rng.choice(players), session=rng.choice(sessions))
        for i in range(n)
    ]


def walk(rows, fold):
    out = {}
    for s in {r["session_id"] for r in rows}:
        members = sorted((r for r in rows if r["session_id"] == s), key=lambda r: (r["captured_at"], r["id"]))
        darts = [rules.Throw(0, r["id"], r["player_id"], r["segment"], r["multiplier"], r["turn_id"]) for r in members]
        for p, line in fold(darts).items():
            out[s, p] = line
    return out


def last_states(states):
    """Per player what remains after the last dart that counted."""
    counted = F.when(F.col("status") != "after", F.struct("captured_at", "id"))
    return {
        (r.session_id, r.player_id): (r.remaining, r.n)
        for r in states.groupBy("session_id", "player_id")
        .agg(F.max_by("remaining", counted).alias("remaining"), F.count("*").alias("n"))
        .collect()
    }


@pytest.mark.parametrize("seed,start,double_out", [(1, 501, True), (2, 101, False), (3, 301, True)])
@pytest.mark.parametrize("large", [False, True])
def test_x01_like_a_walk(spark, request, seed, start, double_out, large):
    if large:
        request.getfixturevalue("hot")
    rows = random_throws(random.Random(seed), 240)
    t = make.table(spark, rows).drop("correction_of")
    states = games.x01_states(t, make.game(spark, "X01", start, double_out, ("s", "t")))
    expected = walk(rows, lambda d: rules.x01(d, start, double_out))
    found = last_states(states)
    assert {k: n for k, (_, n) in found.items()} == {k: line.throws for k, line in expected.items()}
    assert all(found[k][0] in (line.value, None) for k, line in expected.items())
    assert all(found[k][0] == line.value for k, line in expected.items() if found[k][0] is not None)


@pytest.mark.parametrize("large", [False, True])
def test_long_legs_are_worked_off_in_pieces(spark, request, monkeypatch, large):
    if large:
        request.getfixturevalue("hot")
    rng = random.Random(9)
    whats = [rng.choice(["MISS", "S1", "S2", "T20", "S7"]) for _ in range(400)]
    rows = [make.throw(i, w, player=rng.choice("ab")) for i, w in enumerate(whats)]
    t = make.table(spark, rows).drop("correction_of")
    g = make.game(spark, "X01", 701, True)
    whole = {r.id: (r.remaining, r.status, r.turn_no) for r in games.x01_states(t, g).collect()}
    monkeypatch.setattr(games, "TURNS_PER_PIECE", 3)
    monkeypatch.setattr(games, "PIECES_PER_STEP", 4)
    pieces = {r.id: (r.remaining, r.status, r.turn_no) for r in games.x01_states(t, g).collect()}
    assert len(whole) == 400 and pieces == whole
    expected = walk(rows, lambda d: rules.x01(d, 701, True))
    assert all(line.value == min(v[0] for i, v in whole.items() if rows[int(i)]["player_id"] == p) for (_, p), line in expected.items())


def test_a_turn_never_raises_the_score(spark):
    rows = random_throws(random.Random(4), 200, players=("a",), sessions=("s",))
    t = make.table(spark, rows).drop("correction_of")
    states = games.x01_states(t, make.game(spark, "X01", 301)).orderBy("captured_at", "id").collect()
    ends = {}
    for r in states:
        if r.remaining is not None:
            ends[r.turn_no] = r.remaining
    values = [ends[k] for k in sorted(ends)]
    assert values == sorted(values, reverse=True)


def cricket(spark, plays):
    rows = [make.throw(i, w, player=p) for i, (p, w) in enumerate(plays)]
    t = make.table(spark, rows)
    points = {int(r.id): (r.points, r.closes, r.after) for r in games.cricket_points(t).collect()}
    table = {r.player_id: (r.points, r.numbers_closed, r.winner) for r in games.cricket_standings(t).collect()}
    return points, table


def test_cricket_points(spark):
    plays = [
        ("a", "T20"), ("a", "T20"), ("b", "D20"), ("a", "S20"), ("b", "D20"), ("a", "T20"), ("b", "T20"),
        ("b", "DB"), ("b", "DB"), ("a", "S14"),
    ]
    points, table = cricket(spark, plays)
    assert points[0] == (0, True, False)  # closes exactly
    assert points[1] == (60, False, False)  # scores, the other is open
    assert points[3] == (20, False, False)
    assert points[4] == (0, True, False)  # closes with one to spare: a has closed
    assert points[5] == (0, False, False) and points[6] == (0, False, False)
    assert points[8] == (25, True, False)  # 4 marks, one beyond
    assert table == {"a": (80, 1, False), "b": (25, 2, False)}


CLOSE_ALL = ["T15", "T16", "T17", "T18", "T19", "T20", "DB", "SB"]


def test_cricket_winner_needs_the_points(spark):
    plays = [("b", "T20"), ("b", "S20")] + [("a", w) for w in CLOSE_ALL]
    _, table = cricket(spark, plays)
    assert table["a"] == (0, 7, False)
    # a catches up on a number b has open, then wins; what follows does not count
    points, table = cricket(spark, plays + [("a", "S15"), ("a", "S16"), ("b", "T19"), ("a", "T18")])
    assert table["a"] == (15 + 16, 7, True) or table["a"] == (31, 7, True)
    assert [points[i][2] for i in range(10, 14)] == [False, False, True, True]


def test_cricket_equal_points_win(spark):
    _, table = cricket(spark, [("b", "S1")] + [("a", w) for w in CLOSE_ALL])
    assert table == {"a": (0, 7, True), "b": (0, 0, False)}


def test_cricket_three_players(spark):
    plays = [("a", "T20"), ("b", "T20"), ("a", "S20"), ("c", "T20"), ("a", "S20")]
    points, _ = cricket(spark, plays)
    assert points[2][0] == 20 and points[4][0] == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("large", [False, True])
def test_cricket_like_a_walk(spark, request, seed, large):
    if large:
        request.getfixturevalue("hot")
    rows = random_throws(random.Random(seed), 150)
    found = games.cricket_standings(make.table(spark, rows).drop("correction_of"), make.game(spark, "Cricket", sessions=("s", "t"))).collect()
    expected = walk(rows, rules.cricket)
    assert {(r.session_id, r.player_id): (r.points, "winner" if r.winner else "playing") for r in found} == {
        k: (line.value, line.status) for k, line in expected.items()
    }


def test_games_by_time(spark):
    t = make.table(spark, [make.throw(i, second=i) for i in range(5)])
    g = make.game(spark, "X01", started=make.at(1)).unionByName(make.game(spark, "Cricket", started=make.at(3)))
    found = games.asof_game(t, g).orderBy("captured_at").collect()
    assert [r.game_type for r in found] == [None, "X01", "X01", "Cricket", "Cricket"]
    other = games.asof_game(t, make.game(spark, sessions=("z",)))
    assert other.filter("game_type IS NOT NULL").count() == 0


def test_shuffled_rows_change_nothing(spark):
    rows = random_throws(random.Random(8), 120)
    g = make.game(spark, "X01", 301, sessions=("s", "t"))
    a = games.x01_states(make.table(spark, rows).drop("correction_of"), g)
    random.Random(1).shuffle(rows)
    b = games.x01_states(make.table(spark, rows).drop("correction_of"), g)
    assert games.replay_diff(a, b).count() == 0
    changed = a.withColumn("status", F.when(F.col("id") == "7", "x").otherwise(F.col("status")))
    assert sorted(r.only_in for r in games.replay_diff(a, changed).collect()) == ["a", "b"]


@pytest.mark.parametrize("size", [100_000, 4])
@pytest.mark.parametrize("large", [False, True])
def test_fold_another_game(spark, request, monkeypatch, size, large):
    if large:
        request.getfixturevalue("hot")
    monkeypatch.setattr(games, "THROWS_PER_FOLD", size)
    rng = random.Random(6)
    rows = [make.throw(i, rng.choice(["S1", "S5", "T20", "MISS"]), player=rng.choice("aaab")) for i in range(40)]
    found = games.fold_game(
        make.table(spark, rows),
        ["session_id", "player_id"],
        lambda: F.struct(F.lit(300).alias("left"), F.lit("").alias("path")),
        lambda s, dart: F.struct(
            F.greatest(s["left"] - dart["score"], F.lit(0)).alias("left"),
            F.concat(s["path"], dart["id"], F.lit(" ")).alias("path"),
        ),
        lambda s: F.concat(s["path"], s["left"].cast("string")),
    )
    expected = {}
    for p in "ab":
        mine = [r for r in rows if r["player_id"] == p]
        left = max(300 - sum(r["score"] for r in mine), 0)
        expected[p] = "".join(r["id"] + " " for r in mine) + str(left)
    assert {r.player_id: r.state for r in found.collect()} == expected


@pytest.mark.parametrize("size", [100_000, 1, 3, 4])
@pytest.mark.parametrize("large", [False, True])
def test_fold_over_few_states(spark, request, monkeypatch, size, large):
    """A state after the other; the order of darts matters."""
    if large:
        request.getfixturevalue("hot")
    monkeypatch.setattr(games, "THROWS_PER_FOLD", size)
    rng = random.Random(6)
    rows = [make.throw(i, rng.choice(["S1", "S5", "T20", "MISS"]), player=rng.choice("aaab")) for i in range(40)]
    rows.append(make.throw(90, "S1", player="c"))

    def after(state, r):
        return {0: 3, 3: 1}.get(state, state) if r["score"] == 60 else (state + r["score"]) % 5

    found = games.fold_states(
        make.table(spark, rows),
        ["session_id", "player_id"],
        5,
        2,
        lambda s, d: F.when(d["score"] == 60, F.when(s == 0, 3).when(s == 3, 1).otherwise(s)).otherwise((s + d["score"]) % 5),
    )
    want = {}
    for r in rows:
        want[r["player_id"]] = after(want.get(r["player_id"], 2), r)
    assert {r.player_id: r.state for r in found.collect()} == want


def test_rounds_of_a_parallel_fold_grow_with_the_logarithm(spark, monkeypatch):
    """One group of 20,000 throws in 2,000 pieces is put together in eleven rounds."""
    monkeypatch.setattr(games, "THROWS_PER_FOLD", 10)
    throws = spark.range(20_000).select(
        F.lit("s").alias("session_id"), F.timestamp_seconds("id").alias("captured_at"),
        F.format_string("%05d", "id").alias("id"), (F.col("id") % 20).cast("int").alias("segment"),
        F.lit(1).alias("multiplier"), (F.col("id") % 20).cast("int").alias("score"),
    )
    cuts = []
    real = games.cut_lineage
    monkeypatch.setattr(games, "cut_lineage", lambda df: cuts.append(1) or real(df))
    (row,) = games.fold_states(throws, ["session_id"], 7, 0, lambda s, d: (s * 3 + d["score"]) % 7).collect()
    state = 0
    for i in range(20_000):
        state = (state * 3 + i % 20) % 7
    assert row.state == state and len(cuts) == 1 + 11


def test_scoreboard(spark):
    rows = [make.throw(i, "S1", player=p) for i, p in enumerate("abab")]
    board = games.scoreboard(games.running_score(make.table(spark, rows)), ["running_score"]).collect()
    assert {r.player_id: (r.id, r.running_score) for r in board} == {"a": ("2", 2), "b": ("3", 2)}
