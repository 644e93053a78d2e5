"""Streams against the stored tables they come from."""

import random

import dart_by_dart as rules
import make
import pytest
from pyspark.sql import functions as F

from ocheline import schemas
from ocheline.operators import corrections, events, games, vision
from ocheline.sources import once, outbox
from ocheline.streaming import held, live, sources
from registry import fixtures as fx
from registry import streams


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream opens a store of its own."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Feed:
    """A folder of event files, added to batch by batch."""

    def __init__(self, spark, folder):
        self.spark, self.path, self.n = spark, str(folder / "in"), 0
        folder.joinpath("in").mkdir()

    def add(self, rows):
        df = events.nest_throws(make.table(self.spark, rows)).coalesce(1)
        df.write.mode("append").json(self.path)


def run(stream, folder, mode="append", name="out"):
    """Process what has arrived; returns all rows so far with their batch."""
    out = str(folder / name)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = (
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", str(folder / f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    try:
        q.awaitTermination(300)
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.parquet(out)


def last_lines(found, *keys):
    """The newest line per key; lines of one batch are the same refold."""
    lines = found.filter("NOT closed").collect()
    out = {}
    for r in sorted(lines, key=lambda r: r.batch):
        out[tuple(r[k] for k in keys)] = (r.value, r.status, r.throws)
    return out


@pytest.mark.parametrize("kind,start", [("X01", 101), ("Cricket", 0)])
def test_scoreboard_equals_the_batch(spark, tmp_path, kind, start):
    rng = random.Random(11)
    pool = ["MISS", "S1", "S20", "D20", "T20", "T19", "T18", "T17", "T16", "T15", "DB", "SB", "D8"]
    rows = [
        make.throw(i, rng.choice(pool), player=rng.choice("ab"), session="st"[i % 2]) for i in range(60)
    ]
    # corrections come later, also to throws of long ago and to corrections
    rows += [make.throw(100 + i, rng.choice(pool), session="st"[i % 2], second=60 + i, of=i) for i in (0, 1, 7, 20)]
    rows += [make.throw(130, "T20", session="s", second=70, of=100)]
    g = make.game(spark, kind, start, True, ("s", "t"))
    feed = Feed(spark, tmp_path)
    early, late = rows[:40], rows[40:]
    rng.shuffle(early)
    for part in (early[:25], early[20:], late):  # five events come twice
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path, "1 hour")
        found = run(live.live_scores(stream, g), tmp_path, "update")
    final = corrections.effective_throws(make.table(spark, rows))
    got = last_lines(found, "session_id", "player_id")
    if kind == "X01":
        states = games.x01_states(final, g)
        counted = F.when(F.col("status") != "after", F.struct("captured_at", "id"))
        expected = states.groupBy("session_id", "player_id").agg(
            F.max_by("remaining", counted).alias("v"), F.count("*").alias("n")
        )
        assert {k: (v, n) for k, (v, _, n) in got.items()} == {
            (r.session_id, r.player_id): (r.v, r.n) for r in expected.collect()
        }
    else:
        expected = games.cricket_standings(final, g).collect()
        assert {k: (v, s) for k, (v, s, _) in got.items()} == {
            (r.session_id, r.player_id): (r.points, "winner" if r.winner else "playing") for r in expected
        }


def test_idle_session_is_closed(spark, tmp_path):
    g = make.game(spark, "X01", 101, True, ("s", "t"))
    feed = Feed(spark, tmp_path)
    for part in (
        [make.throw(1, "S1")],
        [make.throw(2, "S2", session="t", second=20000)],
        [make.throw(3, "S3", session="t", second=20001)],
    ):
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path, "1 minute")
        found = run(live.live_scores(stream, g, idle="1 hour"), tmp_path, "update")
    closed = found.filter("closed").collect()
    assert [(r.session_id, r.value) for r in closed] == [("s", 100)]


def test_duplicates_and_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    parts = [[make.throw(1, "S1"), make.throw(1, "S1"), make.throw(2, "S2")], [make.throw(2, "S2"), make.throw(3, "S3")], [make.throw(9, "S9", second=90000)], [make.throw(10, "S9", second=90001)]]
    for part in parts:
        feed.add(part)
        stream = sources.once_each(sources.stream_throws(spark, feed.path, "1 minute"))
        once = run(stream, tmp_path, name="once")
        summary = run(
            sources.session_summary(sources.once_each(sources.stream_throws(spark, feed.path, "1 minute")), "30 minutes"),
            tmp_path, name="sessions",
        )
    assert sorted(r.id for r in once.collect()) == ["1", "10", "2", "3", "9"]
    assert [(r.throws, r.points) for r in summary.collect()] == [(3, 6)]


@pytest.mark.parametrize("looked_up", [2_000, 1])
def test_redelivered_after_a_month(spark, tmp_path, monkeypatch, looked_up):
    monkeypatch.setattr(once, "LOOKED_UP", looked_up)
    feed, out = Feed(spark, tmp_path), str(tmp_path / "once")
    month = 30 * 86_400
    parts = [
        [make.throw(1, "S1"), make.throw(1, "S1"), make.throw(2, "S2")],
        [make.throw(2, "S2"), make.throw(3, "S3")],
        [make.throw(9, "S9", second=month)],
        [make.throw(1, "S1", second=month + 5), make.throw(10, "S4", second=month + 6)],
    ]
    for part in parts:
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path, "1 minute")
        q = once.once_ever(stream, out, str(tmp_path / "state"))
        q.awaitTermination(300)
        assert not q.exception()
    found = once.admitted(spark, out, stream.schema).collect()
    assert sorted((r.id, r.notation) for r in found) == [("1", "S1"), ("10", "S4"), ("2", "S2"), ("3", "S3"), ("9", "S9")]
    # A batch that is repeated, as after a failure, neither adds events nor loses them.
    again = make.table(spark, parts[3])
    for _ in range(2):
        once.admit(again, 3, f"{out}/ids", f"{out}/events")
    assert sorted(r.id for r in once.admitted(spark, out, stream.schema).collect()) == ["1", "10", "2", "3", "9"]
    assert once.seen_ids(spark, f"{out}/ids").count() == 5


def test_index_of_ids_has_bloom_filters(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    once.admit(make.table(spark, [make.throw(i) for i in range(50)]), 0, f"{tmp_path}/ids", f"{tmp_path}/events")
    (name, *_) = glob.glob(f"{tmp_path}/ids/bucket=*/batch=0/*.parquet")
    with open(name, "rb") as f:
        raw = f.read()
    plain = f"{tmp_path}/plain.parquet"
    pq.write_table(pq.read_table(name), plain)
    assert len(raw) > len(open(plain, "rb").read())  # the filter is in the file


def test_sides_that_arrive_in_any_order(spark, tmp_path):
    """Each throw has the game in force at its time, once the watermark has passed it."""
    rng = random.Random(3)
    throws = [make.throw(i, session="st"[i % 2]) for i in range(60)]
    starts = [("s", "X01", 301, True, make.at(5)), ("s", "Cricket", 0, True, make.at(30)), ("t", "X01", 501, False, make.at(11)), ("s", "X01", 101, True, make.at(30))]
    feed = Feed(spark, tmp_path)
    path = str(tmp_path / "games")
    parts = [throws[:25], throws[25:], [make.throw(900, second=9000)], [make.throw(901, second=9001)]]
    for k, part in enumerate(parts):
        rng.shuffle(part)
        feed.add(part)
        if k < 2:
            spark.createDataFrame([starts[:1], starts[1:]][k], schemas.GAMES).coalesce(1).write.mode("append").parquet(path)
        left = sources.split_lines(spark.readStream.text(feed.path))[0].select("id", "session_id", "captured_at")
        right = spark.readStream.schema(schemas.GAMES).parquet(path)
        joined = held.live_as_of(left, right, ["session_id"], "captured_at", "started_at", live.GAME, "1 minute", "7 seconds")
        found = run(joined, tmp_path, name="joined")
    batch = games.asof_game(
        make.table(spark, throws).select("id", "session_id", "captured_at"), spark.createDataFrame(starts, schemas.GAMES)
    )
    columns = ["id", "captured_at", *live.GAME]
    key = lambda r: str(tuple(r))
    got = found.where("id < 900").select(*columns).collect()
    assert sorted(got, key=key) == sorted(batch.select(*columns).collect(), key=key)


def test_frames_live(spark, tmp_path):
    rng = random.Random(2)
    rows = [("st"[i % 2], i, make.at(i), rng.randrange(4), "web", 1.0) for i in range(60)]
    schema = schemas.FRAMES
    path = str(tmp_path / "frames")
    batches = [rows[:20], rows[20:40], rows[40:], [(s, 1000, make.at(9000), 0, "web", 1.0) for s in "st"], [(s, 1001, make.at(9001), 0, "web", 1.0) for s in "st"]]
    for part in batches:
        part = list(part)
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).withWatermark("captured_at", "30 seconds")
        seen = run(live.live_throws(stream), tmp_path, name="seen")
        rate = run(sources.live_frame_rate(stream, "10 seconds"), tmp_path, name="rate")
        sliding = run(sources.live_frame_rate(stream, "10 seconds", "5 seconds"), tmp_path, name="sliding")
    expected = vision.detect_throws(spark.createDataFrame(rows, schema))
    columns = ["session_id", "frame_no", "n_tips", "new_tips", "retrieved", "throws_so_far"]
    got = seen.filter("frame_no < 1000").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    whole = rate.filter(F.col("window_start") < F.lit(make.at(100)))
    assert {(r.frames, r.frames_per_second) for r in whole.collect()} == {(10, 1.0)} and whole.count() == 6
    assert sliding.filter(F.col("window_start") < F.lit(make.at(100))).agg(F.sum("frames")).first()[0] == 120


def test_calibrations_arrive(spark, tmp_path):
    cal_schema = schemas.CALIBRATIONS
    cals = spark.createDataFrame([("c", "s", make.at(0), [1.0] * 9, 8), ("d", "s", make.at(50), [2.0] * 9, 8)], cal_schema)
    cals.coalesce(1).write.parquet(str(tmp_path / "cal"))
    feed = Feed(spark, tmp_path)
    feed.add([make.throw(1, second=1), make.throw(2, second=2, calibration_id="d"), make.throw(3, second=9000), make.throw(4, calibration_id="x")])
    stream = sources.stream_throws(spark, feed.path, "1 hour")
    stored = run(sources.with_stored_calibration(stream, cals), tmp_path, name="stored")
    assert sorted(r.id for r in stored.collect()) == ["1", "2", "3"]
    arriving = spark.readStream.schema(cal_schema).parquet(str(tmp_path / "cal")).withWatermark("validated_at", "1 hour")
    both = run(sources.with_arriving_calibration(stream, arriving, "1 hour"), tmp_path, name="both")
    assert [r.id for r in both.collect()] == ["1"]  # 2 came before its calibration, 3 too late


def test_forward_and_review(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    grants = spark.createDataFrame([("one", "s", make.at(0), make.at(50))], "adapter string, session_id string, valid_from timestamp, valid_to timestamp")
    box = str(tmp_path / "outbox")
    for part in ([make.throw(1, confidence=0.2), make.throw(2), make.throw(3, session="t")], [make.throw(2), make.throw(60), make.throw(5)]):
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path)
        q = sources.forward_live(stream, "one", [("score", "points")], grants, box, str(tmp_path / "fw"))
        q.awaitTermination(120)
        r = sources.review_queue(stream, 0.5, str(tmp_path / "routes"), str(tmp_path / "rv"))
        r.awaitTermination(120)
        s = sources.store_throws(stream, str(tmp_path / "store"), str(tmp_path / "st"))
        s.awaitTermination(120)
        assert not (q.exception() or r.exception() or s.exception())
    assert sorted(r.id for r in outbox.delivered(spark, box).collect()) == ["1", "2", "5"]
    routes = spark.read.parquet(str(tmp_path / "routes"))
    assert {(r.route, r["count"]) for r in routes.groupBy("route").count().collect()} == {("review", 1), ("accept", 5)}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6


def test_late_throws_never_bring_the_closing_forward(spark, tmp_path):
    """The newest throw counts for the idle time, not the newest of the last batch."""
    g = make.game(spark, "X01", 101, True, ("s", "t"))
    feed = Feed(spark, tmp_path)
    for part in (
        [make.throw(1, "S1", second=0), make.throw(2, "T10", second=7200)],
        [make.throw(3, "S20", second=5500)],
        [make.throw(8, "S1", session="t", second=9300 + 1800)],
        [make.throw(4, "S12", second=10000)],
        [make.throw(9, "S1", session="t", second=9301 + 1800)],
    ):
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path, "30 minutes")
        found = run(live.live_scores(stream, g, idle="1 hour"), tmp_path, "update")
    assert not found.filter("closed AND session_id = 's'").count()
    assert last_lines(found, "session_id")[("s",)] == (38, "scored", 4)


@pytest.mark.parametrize("kind,start,value", [("X01", 101, 38), ("Cricket", 0, 0)])
def test_closed_session_goes_on_where_it_stood(spark, tmp_path, kind, start, value):
    g = make.game(spark, kind, start, True, ("s", "t"))
    feed = Feed(spark, tmp_path)
    for part in (
        [make.throw(1, "T19"), make.throw(2, "S5")],
        [make.throw(3, "S1", session="t", second=20000)],
        [make.throw(4, "S1", session="t", second=20001)],
        [make.throw(5, "S1", second=20002)],
    ):
        feed.add(part)
        stream = sources.stream_throws(spark, feed.path, "1 minute")
        found = run(live.live_scores(stream, g, idle="1 hour"), tmp_path, "update")
    assert found.filter("closed AND session_id = 's'").count() == 1
    line = last_lines(found, "session_id")[("s",)]
    assert line[0] == value and line[2] == 3


@pytest.mark.parametrize("kind", ["X01", "Cricket"])
def test_legs_resume_from_any_point(kind):
    rng = random.Random(4)
    for _ in range(30):
        throws = [
            rules.Throw(i, str(i), rng.choice("ab"), rng.choice([0, 15, 16, 17, 18, 19, 20, 25, 7]), rng.choice([1, 1, 2]))
            for i in range(60)
        ]
        whole = rules.play(kind, throws, 301, True)
        cut = rng.randrange(61)
        # Both players are known from the start, as in a leg that began.
        opening = rules.play(kind, throws[:cut], 301, True)
        if kind == "Cricket" and len(opening.players) < 2:
            continue
        assert rules.play(kind, throws[cut:], 301, True, opening.saved()).lines() == whole.lines()


def test_lines_that_are_no_events_do_not_end_the_stream(spark, tmp_path):
    g = make.game(spark, "X01", 101, True, ("s",))
    feed = Feed(spark, tmp_path)
    feed.add([make.throw(1, "S1")])
    (tmp_path / "in" / "bad.json").write_text('{"id": "2", "sess\n{"id": "3", "capturedAt": "noon"}\n')
    found = run(live.live_scores(sources.stream_throws(spark, feed.path), g), tmp_path, "update")
    assert [r.value for r in found.collect()] == [100]
    bad = run(sources.stream_rejects(spark, feed.path), tmp_path, name="bad").collect()
    assert {r.reason for r in bad} == {"malformed", "captured_at"} and len(bad) == 2


def test_sampled_frames_equal_the_batch(spark, tmp_path):
    rows = [("st"[i % 2], i, make.at(7 * i), 0, "web", 1.0) for i in range(80)]
    path = str(tmp_path / "frames")
    end = [("end", 1000, make.at(90000), 0, "web", 1.0)]
    for part in (rows[40:], rows[:40], end):
        spark.createDataFrame(part, schemas.FRAMES).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schemas.FRAMES).parquet(path).withWatermark("captured_at", "1 hour")
    seen = run(sources.sampled_frames(stream, "1 minute"), tmp_path, name="sampled")
    expected = vision.sample_frames(spark.createDataFrame(rows, schemas.FRAMES), 60_000)
    assert sorted(r.frame_no for r in seen.collect()) == sorted(r.frame_no for r in expected.collect())


class _State(dict):
    """A map state and the timers of a key."""

    def __init__(self):
        self.timers, self.writes = [], 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]

    def keys(self):
        return iter(list(super().keys()))

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


def test_sparse_rows_share_an_entry():
    state = _State()
    box = held.Held(state, 1_000_000)
    box.add([(n * 1_000_000, n) for n in range(100)])
    assert state.writes == 1 and state.timers == [1]
    state.timers.clear()
    assert sorted(box.due(40_000_000)) == [(n * 1_000_000, n) for n in range(41)]
    assert len(state) == 1 and state.timers == [41_001]
    box.add([(n, n) for n in range(1000)])
    assert len(box.due(50_000_000)) == 1010
    assert sorted(box.due(10**9)) == [(n * 1_000_000, n) for n in range(51, 100)]
    assert not len(state)


def test_a_batch_reads_a_delivery(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "FILE_ROWS", 50, raising=False)
    spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 37) AS ts", "id % 30 AS user_id",
        "if(id % 9 = 0, 'error', 'click') AS event_type", "0D AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen = []
    try:
        query = (
            fx.event_stream(spark, str(tmp_path))
            .writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
            .option("checkpointLocation", f"{tmp_path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    full = [n for n in seen if n]
    assert len(full) == fx.DELIVERIES + 1 and sum(full) == 1001 and full[-1] == 1


def test_state_partitions_follow_the_cores(spark):
    before = spark.conf.get(streams.PARTITIONS)
    spark.conf.set(streams.PARTITIONS, "200")
    try:
        assert streams._stores(spark) == str(streams.STORES_A_CORE * max(8, spark.sparkContext.defaultParallelism))
    finally:
        spark.conf.set(streams.PARTITIONS, before)
    assert streams._stores(spark) == before


class _Kept(_State):
    """A map state of its own for each name, with a count of all accesses."""

    def __init__(self):
        super().__init__()
        self.states, self.calls = {}, 0

    def getMapState(self, name, *_):
        handle = self

        class Counted(_State):
            def __getattribute__(self, what):
                handle.calls += what in ("getValue", "updateValue", "removeKey", "keys", "containsKey")
                return super().__getattribute__(what)

            def containsKey(self, key):
                return key in self

        return self.states.setdefault(name, Counted())


def test_keys_of_a_group_are_held_together():
    """A batch of many keys costs a few accesses; each row has the last payload of its own key."""
    import types

    import pandas as pd

    handle = _Kept()
    asof = held._AsOf(1_000_000)
    asof.init(handle)
    rng = random.Random(5)
    columns = ["at", "side", "key", "body"]

    def until(watermark, rows):
        handle.calls = 0
        list(asof.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)]), None))
        assert handle.calls <= 4
        handle.timers.clear()
        timer = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark, getExpiryTimeInMs=lambda: watermark)
        frames = list(asof.handleExpiredTimer((7,), timer, timer))
        return sorted(tuple(r) for f in frames for r in f[["_left", "_right"]].astype(object).itertuples(index=False))

    def rows(first, last):
        return [
            (rng.randrange(first, last), rng.choice([0, 1, 1]), f"k{n % 100}", f'{{"n": {n}}}') for n in range(first, first + 200)
        ]

    early, late = rows(0, 1000), rows(1000, 3000)
    # Of two right rows at one instant the greater payload wins.
    late += [(1500, 0, "k0", '{"n": 9}'), (1500, 0, "k0", '{"n": 10}'), (1500, 1, "k0", "x")]
    rng.shuffle(late)
    got = [until(1, early), until(3, late)]
    for part, found in zip((early, late), got):
        want = []
        for at, side, key, body in part:
            if side == 1:
                before = [r for r in early + late if r[1] == 0 and r[2] == key and r[0] <= at]
                last = max(before, key=lambda r: (r[0], held._ordered(r[3])), default=None)
                want.append((body, None if last is None else last[3]))
        assert found == sorted(want)
