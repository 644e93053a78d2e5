"""Stateful streams: the live scoreboard and the live throw detector."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ocheline.plans.storage import cut_lineage
from ocheline.streaming import tracks
from ocheline.streaming.held import SPAN, Held, live_as_of, micros_of, passed

SCORES = (
    "session_id string, started_at timestamp, game_type string, player_id string, value int, "
    "status string, throws int, closed boolean"
)
_EVENT = (
    "at bigint, player string, segment int, multiplier int, correction_of string, leg bigint, turn string"
)
# `saved` (JSON) is where a leg stood when it was put away; `roots` the trees of its players since.
_LEG = "game string, start int, double_out boolean, saved string, roots binary"


def _instant(micros: int | None):
    return None if micros is None else pd.Timestamp(micros, unit="us")


GAME = ["started_at", "game_type", "start_score", "double_out"]


class _Nodes:
    """Tree nodes in a map state; a batch reads and writes each once."""

    def __init__(self, state, last):
        self.state, self.last = state, last
        self.known: dict[int, bytes] = {}
        self.changed: set[int] = set()
        self.number = last.get()[0] if last.exists() else 0

    def get(self, node: int) -> bytes:
        if node not in self.known:
            self.known[node] = bytes(self.state.getValue((node,))[0])
        return self.known[node]

    def put(self, node: int, body: bytes) -> None:
        self.known[node] = body
        self.changed.add(node)

    def new(self) -> int:
        self.number += 1
        return self.number

    def flush(self) -> None:
        for node in sorted(self.changed):
            self.state.updateValue((node,), (self.known[node],))
        self.last.update((self.number,))


class _Leg:
    """A leg with the trees of its players."""

    def __init__(self, nodes: _Nodes, game: str, start: int, double_out: bool, saved: str | None, roots: bytes | None):
        self.game, self.start, self.double_out = game, start, double_out
        self.saved = None if saved is None else json.loads(saved)
        self.nodes = nodes
        self.rules = tracks.X01(start, double_out) if game == "X01" else tracks.Cricket()
        known = {} if roots is None else dict(pickle.loads(roots))
        self.tracks = {name: tracks.Track(nodes, self.rules, root) for name, root in known.items()}

    def track(self, player: str | None) -> tracks.Track:
        return self.tracks.setdefault(player, tracks.Track(self.nodes, self.rules))

    def standing(self) -> tracks.Standing:
        if self.game == "X01":
            return tracks.x01_standing(self.tracks, self.start, self.saved)
        return tracks.cricket_standing(self.tracks, self.saved)

    def row(self) -> tuple:
        saved = None if self.saved is None else json.dumps(self.saved)
        roots = pickle.dumps([(n, t.saved()) for n, t in self.tracks.items()], 5) if self.tracks else None
        return self.game, self.start, self.double_out, saved, roots

    def put_away(self) -> None:
        self.saved, self.tracks = self.standing().saved, {}


# A session of at most so many events and legs is one entry of state: reading it whole and walking
# its legs costs less than the accesses to entries of their own.
SMALL = 512


class _Small:
    """A session of few events: all of them by id, and its legs as (game, start, double_out, saved)."""

    def __init__(self, body: bytes | None):
        self.newest, self.timer, self.events, self.legs = (0, None, {}, {}) if body is None else pickle.loads(body)

    def body(self) -> bytes:
        return pickle.dumps((self.newest, self.timer, self.events, self.legs), 5)

    def latest(self) -> dict[str, tuple[int, str]]:
        """The correction in force of each event that has one."""
        found: dict[str, tuple[int, str]] = {}
        for id, event in self.events.items():
            if event[4] is not None and (event[0], id) > found.get(event[4], _NEVER):
                found[event[4]] = (event[0], id)
        return found

    def changed(self, arrived: list[str]) -> set[int]:
        """The legs that what arrived is part of, or corrects."""
        roots = (_root(id, self.events.get) for id in arrived)
        return {self.events[r][5] for r in roots if r is not None and self.events[r][5] is not None}

    def darts(self, legs: set[int]) -> dict[int, list[tuple]]:
        """(time, id, player, dart) of each leg, in order."""
        last, found = self.latest(), {}
        for id, (at, player, _, _, of, leg, turn) in self.events.items():
            if of is None and leg in legs:
                _, _, segment, multiplier, *_ = self.events[_final(id, last.get)]
                found.setdefault(leg, []).append((at, id, player, tracks.Dart(segment, multiplier, turn)))
        return {leg: sorted(rows, key=lambda r: r[:2]) for leg, rows in found.items()}

    def standing(self, leg: int, darts: list[tuple]) -> tracks.Standing:
        game, start, double_out, saved = self.legs[leg]
        thrown = [row[2:] for row in darts]
        if game == "X01":
            return tracks.x01_fold(thrown, start, double_out, saved)
        return tracks.cricket_fold(thrown, saved)


_NEVER = (-(1 << 63), "")


def _root(id: str, event) -> str | None:
    """The throw that a chain of corrections hangs on; none if it has not come, or in a cycle."""
    passed = set()
    while (one := event(id)) is not None:
        if one[4] is None:
            return id
        if id in passed:
            return None
        passed.add(id)
        id = one[4]
    return None


def _final(id: str, correction) -> str:
    while (one := correction(id)) is not None:
        id = one[1]
    return id


class _Scoreboard(StatefulProcessor):
    """Keeps the events of an open session by id, and its darts in a tree per leg and player.

    What arrives changes a path of a tree and costs the chain of its own
    corrections; neither grows with the session but by its logarithm. A session
    with few events is one entry instead, and moves to entries and trees of its
    own once it has more than `SMALL`. When the session is closed its legs are
    put away as they stand and events and trees are dropped, so the state of a
    closed session is a line per leg and player. Throws that come later go on
    from there.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A small session in part 0; empty bytes where it has grown.
        self.small = handle.getMapState("small", "part int", "body binary")
        self.events = handle.getMapState("events", "id string", _EVENT)
        # The correction in force of an event.
        self.latest = handle.getMapState("latest", "id string", "at bigint, by string")
        self.legs = handle.getMapState("legs", "leg bigint", _LEG)
        self.nodes = handle.getMapState("nodes", "node bigint", "body binary")
        self.last = handle.getValueState("last", "node bigint")
        self.newest = handle.getValueState("newest", "at bigint")

    def _event(self, id: str, seen: dict) -> tuple | None:
        """The event of this id, remembered for the batch."""
        if id not in seen:
            seen[id] = tuple(self.events.getValue((id,))) if self.events.containsKey((id,)) else None
        return seen[id]

    def _correction(self, id: str, last: dict) -> tuple | None:
        if id not in last:
            last[id] = tuple(self.latest.getValue((id,))) if self.latest.containsKey((id,)) else None
        return last[id]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if lines := self.arrive(*key, _events(rows)):
            yield _frame(lines)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if lines := self.expire(*key, timerValues.getCurrentWatermarkInMs()):
            yield _frame(lines)

    def _body(self) -> bytes | None:
        # Each access is a call to the engine, so one finds out whether there is a body and what it is.
        return next((bytes(body) for _, (body,) in self.small.iterator()), None)

    def arrive(self, session: str, rows: Iterator[tuple[str, tuple, tuple | None]]) -> list[tuple]:
        """Take rows as `_events` gives them; the lines of the legs that change."""
        body = self._body()
        if body == b"":
            return self._large_arrive(session, rows)
        small = _Small(body)
        room = max(SMALL - len(small.events) - len(small.legs), 0)
        first = list(itertools.islice(rows, room + 1))
        if len(first) <= room:
            return self._small_arrive(session, small, first)
        self._grow(small)
        return self._large_arrive(session, itertools.chain(first, rows))

    def _small_arrive(self, session: str, small: _Small, rows: list[tuple]) -> list[tuple]:
        given: dict[int, tuple] = {}
        arrived = []
        for id, event, game in rows:
            small.newest = max(small.newest, event[0])
            if id in small.events:
                continue
            if event[5] is not None:
                given[event[5]] = game
            small.events[id] = event
            arrived.append(id)
        if not arrived:
            return []
        # The timer may come too early, it is set anew when it does.
        if small.timer is None:
            small.timer = small.newest // 1000 + self.idle_ms
            self.handle.registerTimer(small.timer)
        lines = []
        for leg, darts in small.darts(small.changed(arrived)).items():
            if leg not in small.legs:
                small.legs[leg] = (*given[leg], None)
            lines += _lines(session, leg, small.legs[leg][0], small.standing(leg, darts), closed=False)
        self.small.updateValue((0,), (small.body(),))
        return lines

    def _grow(self, small: _Small) -> None:
        """Move a small session to entries and trees of its own."""
        for id, event in small.events.items():
            self.events.updateValue((id,), event)
        for id, correction in small.latest().items():
            self.latest.updateValue((id,), correction)
        nodes, known = _Nodes(self.nodes, self.last), small.darts(set(small.legs))
        for leg, (game, start, double_out, saved) in small.legs.items():
            one = _Leg(nodes, game, start, double_out, None if saved is None else json.dumps(saved), None)
            players: dict[str | None, dict] = {}
            for at, id, player, dart in known.get(leg, ()):
                players.setdefault(player, {})[(at, id)] = dart
            for player, darts in players.items():
                one.track(player).merge(darts)
            self.legs.updateValue((leg,), one.row())
        nodes.flush()
        self.newest.update((small.newest,))
        self.small.updateValue((0,), (b"",))

    def _large_arrive(self, session: str, rows: Iterable[tuple]) -> list[tuple]:
        seen: dict[str, tuple | None] = {}
        last: dict[str, tuple | None] = {}
        given: dict[int, tuple] = {}
        arrived = []
        newest = self.newest.get()[0] if self.newest.exists() else 0
        for id, event, game in rows:
            newest = max(newest, event[0])
            if self._event(id, seen) is not None:
                continue
            if event[5] is not None:
                given[event[5]] = game
            seen[id] = event
            self.events.updateValue((id,), event)
            arrived.append(id)
            of = event[4]
            if of is not None:
                before = self._correction(of, last)
                if before is None or (event[0], id) > before:
                    last[of] = (event[0], id)
                    self.latest.updateValue((of,), (event[0], id))
        if not arrived:
            return []
        self.newest.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.idle_ms)
        changed: dict[tuple, dict] = {}
        for id in arrived:
            root = _root(id, lambda one: self._event(one, seen))
            if root is not None and seen[root][5] is not None:
                at, player, _, _, _, leg, turn = seen[root]
                value = self._event(_final(root, lambda one: self._correction(one, last)), seen)
                changed.setdefault((leg, player), {})[(at, root)] = tracks.Dart(value[2], value[3], turn)
        nodes, legs = _Nodes(self.nodes, self.last), {}
        for (leg, player), darts in changed.items():
            if leg not in legs:
                stored = tuple(self.legs.getValue((leg,))) if self.legs.containsKey((leg,)) else (*given[leg], None, None)
                legs[leg] = _Leg(nodes, *stored)
            legs[leg].track(player).merge(darts)
        lines = []
        for leg, one in legs.items():
            lines += _lines(session, leg, one.game, one.standing(), closed=False)
            self.legs.updateValue((leg,), one.row())
        nodes.flush()
        return lines

    def expire(self, session: str, watermark: int) -> list[tuple]:
        """The last lines of a session that the watermark has passed for long enough."""
        body = self._body()
        if body == b"":
            return self._large_expire(session)
        small, lines = _Small(body), []
        small.timer = small.newest // 1000 + self.idle_ms
        if small.timer >= watermark:  # there were throws since the timer was set
            self.handle.registerTimer(small.timer)
        else:
            for leg, darts in small.darts(set(small.legs)).items():
                standing = small.standing(leg, darts)
                lines += _lines(session, leg, small.legs[leg][0], standing, closed=True)
                small.legs[leg] = (*small.legs[leg][:3], standing.saved)
            small.events, small.timer = {}, None
        self.small.updateValue((0,), (small.body(),))
        return lines

    def _large_expire(self, session: str) -> list[tuple]:
        nodes, lines = _Nodes(self.nodes, self.last), []
        for (leg,), stored in list(self.legs.iterator()):
            one = _Leg(nodes, *stored)
            if one.tracks:
                lines += _lines(session, leg, one.game, one.standing(), closed=True)
                one.put_away()
                self.legs.updateValue((leg,), one.row())
        for state in (self.events, self.latest, self.nodes, self.last):
            state.clear()
        return lines

    def close(self) -> None:
        pass


_ROW = ("id", "at", "player_id", "segment", "multiplier", "correction_of", "leg", "turn_id", *GAME[1:])


class _ScoreboardOfRows(_Scoreboard):
    """The scoreboard with each row as JSON: a session with few rows costs no frames of its own."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        parsed = (json.loads(row.body).values() for row in rows)
        return map(_row, self.arrive(*key, map(_event, parsed)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return map(_row, self.expire(*key, timerValues.getCurrentWatermarkInMs()))


def _events(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, tuple, tuple | None]]:
    """The id, the event as it is kept, and the game in force of each row."""
    for batch in batches:
        yield from map(_event, zip(*(batch[c].tolist() for c in _ROW)))


def _event(row: Iterable) -> tuple[str, tuple, tuple | None]:
    id, at, player, segment, multiplier, of, leg, turn, game, start, double_out = row
    leg = None if leg is None or leg != leg else int(leg)  # frames have NaN for none
    event = (int(at), player, int(segment), int(multiplier), of, leg, turn)
    return id, event, None if leg is None else (game, int(start), bool(double_out))


def _lines(session: str, leg: int, game: str, standing: tracks.Standing, closed: bool) -> list[tuple]:
    return [
        (session, leg, game, player, line.value, line.status, line.throws, closed)
        for player, line in standing.lines.items()
    ]


_LINE = ["session_id", "started_at", "game_type", "player_id", "value", "status", "throws", "closed"]
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _frame(lines: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(session, _instant(leg), *rest) for session, leg, *rest in lines], columns=_LINE)


def _row(line: tuple) -> Row:
    session, leg, *rest = line
    return Row(*_LINE)(session, _EPOCH + dt.timedelta(microseconds=leg), *rest)


def live_scores(
    stream: DataFrame, games: DataFrame, idle: str = "2 hours", lateness: str = "10 minutes", span: str = SPAN
) -> DataFrame:
    """The scoreboard lines that change with each batch; closed after `idle`.

    The game in force is the last one started by the time of a throw. `games` is
    stored, or a stream of its own: then both streams come without a watermark,
    `lateness` is that of the two together, throws are scored once the watermark
    has passed them, and the query runs in append mode. A correction re-scores the leg of the throw it corrects, unless
    that was closed before: what is closed stands, and stored corrections are
    resolved in batch. When a session is idle for so long that the watermark
    passes, its last lines come once more as `closed`, and its throws are
    dropped; a later throw goes on from those lines.
    """
    columns = ["session_id", "captured_at", "id", "player_id", "turn_id", "segment", "multiplier", "correction_of"]
    if games.isStreaming:
        timed = live_as_of(
            stream.select(*columns), games, ["session_id"], "captured_at", "started_at", GAME, lateness, span
        )
        in_force = {c: F.col(c) for c in GAME}
    else:
        # Written once, so that a batch reads one row per session.
        per_session = cut_lineage(
            games.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*GAME))).alias("_games"))
        )
        begun = F.filter("_games", lambda g: g["started_at"] <= F.col("captured_at"))
        timed = stream.join(per_session, "session_id", "left").withColumn("_game", F.try_element_at(begun, F.lit(-1)))
        in_force = {c: F.col(f"_game.{c}") for c in GAME}
    fields = {
        "at": F.unix_micros("captured_at"),
        "leg": F.unix_micros(in_force["started_at"].cast("timestamp")),
        **{c: in_force[c] for c in GAME[1:]},
    }
    row = F.struct(*[fields.get(c, F.col(c)).alias(c) for c in _ROW])
    rows = timed.select("session_id", "captured_at", F.to_json(row, {"ignoreNullFields": "false"}).alias("body"))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("session_id").transformWithState(
        statefulProcessor=_ScoreboardOfRows(idle_ms),
        outputStructType=SCORES,
        outputMode="Append" if games.isStreaming else "Update",
        timeMode="EventTime",
    )


THROWS_SEEN = (
    "session_id string, frame_no bigint, captured_at timestamp, n_tips bigint, new_tips bigint, "
    "retrieved boolean, throws_so_far bigint"
)


class _Detector(StatefulProcessor):
    """Holds frames back until the watermark passes them, then reads them in order."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Held(handle, self.span)
        self.seen = handle.getValueState("seen", "n_tips bigint, throws bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for batch in rows:
            arrived += list(zip(*(batch[c].astype(int).tolist() for c in ("at", "frame_no", "n_tips"))))
        self.held.add(arrived)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (session,) = key
        # All that the watermark has passed, not only the frame that set the timer.
        ready = sorted(self.held.due(passed(timerValues, expiredTimerInfo)))
        if not ready:
            return
        before, throws = self.seen.get() if self.seen.exists() else (0, 0)
        out = []
        for at, frame_no, n_tips in ready:
            new = max(n_tips - before, 0)
            throws += new
            out.append((session, frame_no, _instant(at), n_tips, new, n_tips == 0 < before, throws))
            before = n_tips
        self.seen.update((before, throws))
        yield pd.DataFrame(
            out,
            columns=[
                "session_id", "frame_no", "captured_at", "n_tips", "new_tips", "retrieved",
                "throws_so_far",
            ],
        )

    def close(self) -> None:
        pass


def live_throws(frames: DataFrame, span: str = SPAN) -> DataFrame:
    """T5: throws seen in a stream of frames, each frame once, in capture order.

    A frame is read when the watermark has passed it, so frames that arrive out
    of order give what the stored table gives. Until then frames are held in
    entries of at most `span` each.
    """
    rows = frames.select(
        "session_id", "captured_at", F.unix_micros("captured_at").alias("at"), "frame_no", "n_tips"
    )
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=_Detector(micros_of(span)),
        outputStructType=THROWS_SEEN,
        outputMode="Append",
        timeMode="EventTime",
    )
