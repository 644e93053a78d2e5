"""Trees of darts against the same legs dart by dart."""

import math
import random

import dart_by_dart as rules
import pandas as pd
import pytest

from ocheline.streaming import live, tracks

SEGMENTS = [0, 15, 16, 17, 18, 19, 20, 25, 7]


class Store:
    """Nodes in a dict, with a count of what is read and written."""

    def __init__(self):
        self.kept, self.reads, self.writes, self.n = {}, 0, 0, 0

    def get(self, node):
        self.reads += 1
        return self.kept[node]

    def put(self, node, body):
        self.writes += 1
        self.kept[node] = body

    def new(self):
        self.n += 1
        return self.n


def standing(kind, trees, start, saved=None):
    return tracks.x01_standing(trees, start, saved) if kind == "X01" else tracks.cricket_standing(trees, saved)


def lines(found):
    return {name: tuple(line) for name, line in found.items()}


@pytest.mark.parametrize("kind", ["X01", "Cricket"])
@pytest.mark.parametrize("seed", range(8))
def test_random_legs_with_late_and_corrected_darts(monkeypatch, kind, seed):
    monkeypatch.setattr(tracks, "LEAF", 6)
    monkeypatch.setattr(tracks, "FAN", 4)
    rng = random.Random(seed)
    for _ in range(12):
        start, double_out = rng.choice([(101, True), (301, True), (170, False), (1001, True)])
        names = rng.sample(["a", "b", "c", None if kind == "X01" else "d"], rng.choice([1, 2, 2, 3]))
        ids = rng.random() < 0.5  # some legs have turn ids, which may cut turns short
        make_rules = (lambda: tracks.X01(start, double_out)) if kind == "X01" else tracks.Cricket
        store, roots, known = Store(), {}, {}
        for _ in range(rng.randint(1, 12)):
            change = {}
            for _ in range(rng.choice([1, 1, 2, 30])):
                if known and rng.random() < 0.3:
                    key, player = rng.choice(list(known))
                else:
                    at = rng.randrange(2000)
                    key, player = (at, str(rng.randrange(10**6))), rng.choice(names)
                turn = f"t{key[0] // rng.choice([3, 9])}" if ids and rng.random() < 0.7 else None
                change.setdefault(player, {})[key] = tracks.Dart(rng.choice(SEGMENTS), rng.choice([1, 1, 2, 3]), turn)
                known[key, player] = change[player][key]
            trees = {n: tracks.Track(store, make_rules(), r) for n, r in roots.items()}
            for player, darts in change.items():
                trees.setdefault(player, tracks.Track(store, make_rules())).merge(darts)
            roots = {n: t.saved() for n, t in trees.items()}
            throws = [rules.Throw(k[0], k[1], p, d.segment, d.multiplier, d.turn) for (k, p), d in sorted(known.items(), key=lambda x: x[0][0])]
            want = rules.play(kind, throws, start, double_out).lines()
            assert lines(standing(kind, trees, start).lines) == lines(want)


@pytest.mark.parametrize("kind", ["X01", "Cricket"])
@pytest.mark.parametrize("seed", range(6))
def test_legs_go_on_from_where_they_were_put_away(kind, seed):
    rng = random.Random(seed)
    for _ in range(20):
        throws = [rules.Throw(i, str(i), rng.choice("ab"), rng.choice(SEGMENTS), rng.choice([1, 1, 2])) for i in range(rng.choice([30, 90]))]
        cut = rng.randrange(2, len(throws))
        if kind == "Cricket" and len({t.player for t in throws[:cut]}) < 2:
            continue
        want = rules.play(kind, throws, 201, True).lines()
        saved = None
        for part in (throws[:cut], throws[cut:]):
            trees = {}
            for t in part:
                tree = trees.setdefault(t.player, tracks.Track(Store(), tracks.X01(201, True) if kind == "X01" else tracks.Cricket()))
                tree.merge({(t.at, t.id): tracks.Dart(t.segment, t.multiplier, t.turn)})
            found = standing(kind, trees, 201, saved)
            saved = found.saved
        assert lines(found.lines) == lines(want)


def test_a_path_is_read_and_written_not_the_leg():
    """100,000 darts of one player: a dart or a correction touches a few nodes."""
    rng = random.Random(7)
    store = Store()
    tree = tracks.Track(store, tracks.X01(501, True))
    # Darts that never finish: what is left stays odd or a bust.
    darts = {(i, str(i)): tracks.Dart(rng.choice([1, 3, 20]), 3, None) for i in range(0, 200_000, 2)}
    tree.merge(darts)
    assert tree.count == 100_000
    nodes = len(store.kept)
    for key in ((200_001, "new"), (100_001, "late"), (50_000, "50000"), (0, "0")):
        store.reads = store.writes = 0
        tree.merge({key: tracks.Dart(19, 1, None)})
        tracks.x01_standing({"p": tree}, 501, None)
        most = 4 * math.ceil(math.log(nodes, tracks.FAN / 2))
        assert store.writes <= most and store.reads <= 2 * most, (store.reads, store.writes, nodes)
    throws = [rules.Throw(k[0], k[1], "p", d.segment, d.multiplier) for k, d in sorted({
        **darts, (200_001, "new"): tracks.Dart(19, 1), (100_001, "late"): tracks.Dart(19, 1),
        (50_000, "50000"): tracks.Dart(19, 1), (0, "0"): tracks.Dart(19, 1),
    }.items())]
    want = rules.play("X01", throws, 501, True).lines()
    assert lines(tracks.x01_standing({"p": tree}, 501, None).lines) == lines(want)


class Handle:
    """State of one key as the engine keeps it, with a count of accesses."""

    def __init__(self):
        self.kept, self.timers, self.reads = {}, set(), 0

    def _of(self, name):
        handle, kept = self, self.kept.setdefault(name, {})

        class State:
            def exists(self):
                return bool(kept)

            def get(self):
                return kept[()]

            def update(self, value):
                kept[()] = value

            def containsKey(self, key):
                handle.reads += 1
                return key in kept

            def getValue(self, key):
                handle.reads += 1
                return kept[key]

            def updateValue(self, key, value):
                kept[key] = value

            def iterator(self):
                return iter(kept.items())

            def clear(self):
                kept.clear()

        return State()

    def getMapState(self, name, *_):
        return self._of(name)

    def getValueState(self, name, *_):
        return self._of(name)

    def listTimers(self):
        return iter(set(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def batch(rows, leg=0, game="X01"):
    return pd.DataFrame(
        [(i, i * 1000 if at is None else at, p, s, m, of, leg, game, 501, True, None) for i, at, p, s, m, of in rows],
        columns="id at player_id segment multiplier correction_of leg game_type start_score double_out turn_id".split(),
    ).astype({"id": str, "correction_of": object})


def test_state_reads_of_a_long_session():
    """The processor itself: with 100,000 throws kept, a batch reads a few dozen entries."""
    handle = Handle()
    board = live._Scoreboard(10_000)
    board.init(handle)
    rows = [(str(k), k, "ab"[k % 2], 1, 3, None) for k in range(100_000)]
    rng = random.Random(3)
    rng.shuffle(rows)
    for s in range(0, len(rows), 25_000):
        list(board.handleInputRows(("s",), iter([batch(rows[s : s + 25_000])]), None))
    assert len(handle.kept["events"]) == 100_000
    handle.reads = 0
    arriving = [("x", 500_000, "a", 20, 3, None), ("c", 500_001, None, 5, 1, "777"), ("d", 500_002, None, 7, 1, "c")]
    (found,) = list(board.handleInputRows(("s",), iter([batch(arriving)]), None))
    assert handle.reads < 120, handle.reads
    value = {id: (s, m) for id, _, _, s, m, _ in rows} | {"777": (7, 1), "x": (20, 3)}
    throws = [rules.Throw(at, id, p, *value[id]) for id, at, p, *_ in sorted([*rows, arriving[0]], key=lambda r: r[1])]
    want = rules.play("X01", throws, 501, True).lines()
    assert {r.player_id: (r.value, r.status, r.throws) for r in found.itertuples()} == lines(want)


class _Timers:
    """What a processor is told of the time."""

    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def _played(small, parts, monkeypatch):
    """All lines of a session whose rows come in parts; None closes it. The last handle as well."""
    monkeypatch.setattr(live, "SMALL", small, raising=False)
    handle, out = Handle(), []
    board = live._Scoreboard(10)
    board.init(handle)
    for part in parts:
        if part is None:
            found = board.handleExpiredTimer(("s",), _Timers(10**12), None)
            handle.timers.clear()
        else:
            found = board.handleInputRows(("s",), iter(part), None)
        rows = [tuple(r) for frame in found for r in frame.itertuples(index=False)]
        out.append(sorted(rows, key=str))
    return out, handle


@pytest.mark.parametrize("game", ["X01", "Cricket"])
def test_a_small_session_has_the_lines_of_a_large_one(monkeypatch, game):
    """Late and repeated throws, chains of corrections, closings; some sessions grow on the way."""
    for seed in range(25):
        rng = random.Random(seed)
        ids, parts = [], []
        for _ in range(rng.randint(2, 7)):
            rows = []
            for _ in range(rng.choice([1, 5, 40])):
                of = rng.choice([*ids, "lost"]) if ids and rng.random() < 0.3 else None
                id = rng.choice(ids) if ids and rng.random() < 0.1 else str(len(ids))
                ids.append(id)
                rows.append((id, rng.randrange(10**6), rng.choice("ab"), rng.choice(SEGMENTS), rng.choice([1, 2, 3]), of))
            legs = [batch(rows[k::2], leg=k, game=game) for k in range(2) if rows[k::2]]
            parts.append(legs)
            if rng.random() < 0.2:
                parts.append(None)
        parts.append(None)
        want, _ = _played(-1, parts, monkeypatch)
        for small in (30, 10**6):
            assert _played(small, parts, monkeypatch)[0] == want, (seed, small)


def test_a_small_session_is_one_entry_of_state(monkeypatch):
    """A few accesses for each batch of a session, however many throws it brings."""
    calls = []

    class Counted(Handle):
        def _of(self, name):
            state = super()._of(name)

            class State:
                def __getattr__(self, what):
                    calls.append((name, what))
                    return getattr(state, what)

            return State()

    board = live._Scoreboard(10)
    board.init(Counted())
    for part in range(4):
        rows = [(str(k), k, "ab"[k % 2], 1, 1, None) for k in range(30 * part, 30 * part + 30)]
        calls.clear()
        (found,) = board.handleInputRows(("s",), iter([batch(rows)]), None)
        assert len(calls) <= 4, calls
    assert {r.player_id: (r.value, r.throws) for r in found.itertuples()} == {"a": (441, 60), "b": (441, 60)}
