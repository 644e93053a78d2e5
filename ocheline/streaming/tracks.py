"""A player's darts in a leg as a tree, so that a dart costs a path and not the leg.

Darts stand in leaves in the order of their keys (time, id). Each node's parent
holds a summary of what the node's darts do; summaries of neighbours add up to
that of both. A dart that arrives or is corrected changes one leaf and the
summaries on the way up: some log(n) nodes are read and written, whatever the
length of the leg. Nodes that grow too large are split.

X01: where a run of darts begins in a turn is not known, so its summary has three
cases, for 0, 1 and 2 darts of the turn before it. Each has the darts that still
belong to that turn, what the whole turns after it do as a table "left before →
left after", and the darts of the last turn. Cricket: marks by number.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterable
from typing import NamedTuple, Protocol

import numpy as np

from ocheline.schemas import CRICKET_NUMBERS

LEAF = 64
FAN = 16

Key = tuple[int, str]


class Dart(NamedTuple):
    segment: int
    multiplier: int
    turn: str | None = None


class Nodes(Protocol):
    """Where nodes are kept; `new` gives a number that none has."""

    def get(self, node: int) -> bytes: ...

    def put(self, node: int, body: bytes) -> None: ...

    def new(self) -> int: ...


class Player:
    """X01 of one player, dart by dart: the state between two darts."""

    __slots__ = ("left", "status", "turn", "darts", "base")

    def __init__(self, left: int, status: str = "", turn: str | None = None, darts: int = 3, base: int | None = None):
        self.left, self.status, self.turn, self.darts = left, status, turn, darts
        self.base = left if base is None else base

    def add(self, d: Dart, double_out: bool) -> None:
        if self.darts == 3 or self.turn != d.turn:
            self.darts, self.base, self.turn = 0, self.left, d.turn
        self.darts += 1
        if self.left == 0 and self.status in ("finish", "after"):
            self.status = "after"
        elif self.darts > 1 and self.status in ("bust", "void"):
            self.status = "void"
        else:
            rest = self.left - d.segment * d.multiplier
            if rest == 0 and (d.multiplier == 2 or not double_out):
                self.left, self.status = 0, "finish"
            elif rest <= 0 or (rest == 1 and double_out):
                self.left, self.status = self.base, "bust"
            else:
                self.left, self.status = rest, "scored"


class Case(NamedTuple):
    """A run of darts behind so many darts of a turn."""

    head: tuple[Dart, ...]  # they still belong to that turn
    table: np.ndarray | None  # what the whole turns then do, none if there are none
    tail: tuple[Dart, ...]  # the last turn, empty if all belong to the turn before


class X01Sum(NamedTuple):
    count: int
    first: str | None
    cases: tuple[Case, Case, Case]


class X01:
    """Summaries of X01 darts; `start` bounds the tables."""

    def __init__(self, start: int, double_out: bool):
        self.start, self.double_out = start, double_out
        self.every = np.arange(start + 1, dtype=np.int32)

    def turn(self, darts: Iterable[Dart]) -> np.ndarray:
        """Left after a whole turn, for each number that can be left before it."""
        left, alive = self.every.copy(), self.every > 0
        for d in darts:
            rest = left - d.segment * d.multiplier
            finish = alive & (rest == 0) & (d.multiplier == 2 or not self.double_out)
            bust = alive & ~finish & ((rest <= 0) | ((rest == 1) & self.double_out))
            left = np.where(finish, 0, np.where(bust, self.every, np.where(alive, rest, left)))
            alive &= ~(finish | bust)
        return left.astype(np.int32)

    def then(self, first: np.ndarray | None, second: np.ndarray | None) -> np.ndarray | None:
        if first is None or second is None:
            return first if second is None else second
        return second[first]

    def leaf(self, darts: list[Dart]) -> X01Sum:
        return X01Sum(len(darts), darts[0].turn, tuple(self._case(darts, p) for p in range(3)))

    def _case(self, darts: list[Dart], before: int) -> Case:
        n = 0
        while before and n < len(darts) and before + n < 3 and darts[n].turn == darts[0].turn:
            n += 1
        head, table, at = tuple(darts[:n]), None, n
        while at < len(darts):
            end = at + 1
            while end < len(darts) and end - at < 3 and darts[end].turn == darts[at].turn:
                end += 1
            if end == len(darts):
                break
            table = self.then(table, self.turn(darts[at:end]))
            at = end
        return Case(head, table, tuple(darts[at:]))

    def both(self, a: X01Sum, b: X01Sum) -> X01Sum:
        cases = []
        for before, one in enumerate(a.cases):
            last = one.tail or one.head
            darts = len(one.tail) or before + len(one.head)
            goes_on = darts if darts < 3 and last[-1].turn == b.first else 0
            other = b.cases[goes_on]
            if one.tail:
                turn = one.tail + other.head
                if other.tail:
                    table = self.then(self.then(one.table, self.turn(turn)), other.table)
                    cases.append(Case(one.head, table, other.tail))
                else:
                    cases.append(Case(one.head, one.table, turn))
            else:
                cases.append(Case(one.head + other.head, other.table, other.tail))
        return X01Sum(a.count + b.count, a.first, tuple(cases))

    def advance(self, p: Player, run: X01Sum) -> None:
        """Take a player through a run."""
        case = run.cases[p.darts if p.darts < 3 and p.turn == run.first else 0]
        for d in case.head:
            p.add(d, self.double_out)
        if case.table is not None:
            if p.left > 0:
                p.left = int(case.table[p.left])
                p.status = "after" if p.left == 0 else ""
            p.darts = 3
        if case.tail:
            p.darts = 3  # the last turn is one of its own
        for d in case.tail:
            p.add(d, self.double_out)

    def plain(self, run: X01Sum) -> tuple:
        cases = [
            ([tuple(d) for d in c.head], None if c.table is None else c.table.astype(np.int16 if self.start < 1 << 15 else np.int32), [tuple(d) for d in c.tail])
            for c in run.cases
        ]
        return run.count, run.first, cases

    def run(self, plain: tuple) -> X01Sum:
        count, first, cases = plain
        return X01Sum(
            count, first, tuple(Case(tuple(Dart(*d) for d in h), t, tuple(Dart(*d) for d in last)) for h, t, last in cases)
        )


class CricketSum(NamedTuple):
    count: int
    marks: tuple[int, ...]


class Cricket:
    """Summaries of Cricket darts: marks of each number."""

    def leaf(self, darts: list[Dart]) -> CricketSum:
        marks = [0] * len(CRICKET_NUMBERS)
        for d in darts:
            if d.segment in CRICKET_NUMBERS:
                marks[CRICKET_NUMBERS.index(d.segment)] += d.multiplier
        return CricketSum(len(darts), tuple(marks))

    def both(self, a: CricketSum, b: CricketSum) -> CricketSum:
        return CricketSum(a.count + b.count, tuple(x + y for x, y in zip(a.marks, b.marks)))

    def plain(self, run: CricketSum) -> tuple:
        return tuple(run)

    def run(self, plain: tuple) -> CricketSum:
        return CricketSum(*plain)


class Entry(NamedTuple):
    """A node as its parent knows it."""

    first: Key
    node: int
    run: X01Sum | CricketSum


class Track:
    """The tree of one player in one leg; `saved` is what the caller keeps, None at first."""

    def __init__(self, nodes: Nodes, rules: X01 | Cricket, saved: tuple | None = None):
        self.nodes, self.rules = nodes, rules
        self.root = None if saved is None else self._entry(saved)

    def saved(self) -> tuple:
        return self._plain(self.root)

    # Stored as plain tuples, so that what reads them needs no class of ours.
    def _plain(self, e: Entry) -> tuple:
        return e.first, e.node, self.rules.plain(e.run)

    def _entry(self, plain: tuple) -> Entry:
        return Entry(plain[0], plain[1], self.rules.run(plain[2]))

    def merge(self, darts: dict[Key, Dart]) -> None:
        """Add darts, or replace those with the same key."""
        if not darts:
            return
        items = sorted(darts.items())
        if self.root is None:
            entries = self._leaves([], items, None)
        else:
            entries = self._merged(self.root.node, items)
        while len(entries) > 1:
            entries = self._inner(entries, None)
        self.root = entries[0]

    def _read(self, node: int) -> tuple[bool, list]:
        leaf, content = pickle.loads(self.nodes.get(node))
        return leaf, [(k, Dart(*d)) for k, d in content] if leaf else [self._entry(e) for e in content]

    def _write(self, node: int, leaf: bool, content: list) -> None:
        plain = [(k, tuple(d)) for k, d in content] if leaf else [self._plain(e) for e in content]
        self.nodes.put(node, pickle.dumps((leaf, plain), 5))

    def _merged(self, node: int, items: list) -> list[Entry]:
        leaf, content = self._read(node)
        if leaf:
            return self._leaves(content, items, node)
        firsts = [e.first for e in content]
        out, at = [], 0
        for k, entry in enumerate(content):
            end = bisect_left(items, (firsts[k + 1],), at) if k + 1 < len(content) else len(items)
            out += self._merged(entry.node, items[at:end]) if end > at else [entry]
            at = end
        return self._inner(out, node)

    def _leaves(self, old: list, new: list, node: int | None) -> list[Entry]:
        items = sorted({**dict(old), **dict(new)}.items())
        out = []
        for part in _split(items, LEAF):
            at = self.nodes.new() if node is None else node
            node = None
            self._write(at, True, part)
            out.append(Entry(part[0][0], at, self.rules.leaf([d for _, d in part])))
        return out

    def _inner(self, entries: list[Entry], node: int | None) -> list[Entry]:
        out = []
        for part in _split(entries, FAN):
            at = self.nodes.new() if node is None else node
            node = None
            self._write(at, False, part)
            run = part[0].run
            for e in part[1:]:
                run = self.rules.both(run, e.run)
            out.append(Entry(part[0].first, at, run))
        return out

    @property
    def count(self) -> int:
        return self.root.run.count if self.root else 0

    def walk(self, enter: Callable[[Entry, Key | None], bool], dart: Callable[[Key, Dart], bool]) -> None:
        """Go through the darts in order until `dart` says so.

        `enter` sees each node first, with the first key after it (None at the
        end), and says whether to look into it; else its darts are passed over.
        """
        if self.root is not None:
            self._walk(self.root, None, enter, dart)

    def _walk(self, entry: Entry, after: Key | None, enter, dart) -> bool:
        if not enter(entry, after):
            return False
        leaf, content = self._read(entry.node)
        if leaf:
            return any(dart(key, d) for key, d in content)
        for k, child in enumerate(content):
            if self._walk(child, content[k + 1].first if k + 1 < len(content) else after, enter, dart):
                return True
        return False


def _split(items: list, most: int) -> list[list]:
    """Parts of equal size, each at most `most`; half full when there are several, so splits are rare."""
    if len(items) <= most:
        return [items]
    parts = -(-len(items) // (most // 2))
    step = -(-len(items) // parts)
    return [items[s : s + step] for s in range(0, len(items), step)]


def _copy(p: Player) -> Player:
    return Player(p.left, p.status, p.turn, p.darts, p.base)


def x01_until(track: Track, p: Player, end: Key | None) -> bool:
    """Take `p` through the darts up to `end` (inclusive, None: all); True if there are later ones."""
    rules: X01 = track.rules
    more = False

    def enter(entry: Entry, after: Key | None) -> bool:
        nonlocal more
        if end is None or (after is not None and after <= end):
            rules.advance(p, entry.run)
            return False
        if entry.first > end:
            more = True
            return False
        return True

    def dart(key: Key, d: Dart) -> bool:
        nonlocal more
        if key > end:
            more = True
            return True
        p.add(d, rules.double_out)
        return False

    track.walk(enter, dart)
    return more


def x01_finish(track: Track, before: Player) -> Key | None:
    """The key of the dart that finishes, for a player who stands at `before`."""
    rules: X01 = track.rules
    p, found = _copy(before), None

    def enter(entry: Entry, after: Key | None) -> bool:
        ahead = _copy(p)
        rules.advance(ahead, entry.run)
        if ahead.left == 0:
            return True
        p.left, p.status, p.turn, p.darts, p.base = ahead.left, ahead.status, ahead.turn, ahead.darts, ahead.base
        return False

    def dart(key: Key, d: Dart) -> bool:
        nonlocal found
        p.add(d, rules.double_out)
        if p.left == 0:
            found = key
        return p.left == 0

    if before.left > 0:
        track.walk(enter, dart)
    return found


def marks_until(track: Track, end: Key | None, inclusive: bool = True) -> list[int]:
    """Marks of each number by the darts up to `end` (None: all)."""
    sums = [0] * len(CRICKET_NUMBERS)

    def add(marks: Iterable[int]) -> None:
        for k, m in enumerate(marks):
            sums[k] += m

    def enter(entry: Entry, after: Key | None) -> bool:
        if end is None or (after is not None and after <= end):
            add(entry.run.marks)
            return False
        return entry.first <= end

    def dart(key: Key, d: Dart) -> bool:
        if key > end or (key == end and not inclusive):
            return True
        add(Cricket().leaf([d]).marks)
        return False

    track.walk(enter, dart)
    return sums


def marks_reached(track: Track, number: int, want: int) -> Key | None:
    """The dart with which the marks of the number at this place come to `want`."""
    so_far, found = 0, None

    def enter(entry: Entry, after: Key | None) -> bool:
        nonlocal so_far
        if so_far + entry.run.marks[number] >= want:
            return True
        so_far += entry.run.marks[number]
        return False

    def dart(key: Key, d: Dart) -> bool:
        nonlocal so_far, found
        if d.segment == CRICKET_NUMBERS[number]:
            so_far += d.multiplier
        if so_far >= want:
            found = key
        return found is not None

    track.walk(enter, dart)
    return found


def key_at(track: Track, rank: int) -> Key:
    """The key of the dart with so many before it."""
    passed, found = 0, None

    def enter(entry: Entry, after: Key | None) -> bool:
        nonlocal passed
        if passed + entry.run.count > rank:
            return True
        passed += entry.run.count
        return False

    def dart(key: Key, d: Dart) -> bool:
        nonlocal passed, found
        if passed == rank:
            found = key
        passed += 1
        return found is not None

    track.walk(enter, dart)
    return found


def rank_of(track: Track, key: Key) -> int:
    """How many darts stand before `key`."""
    passed = 0

    def enter(entry: Entry, after: Key | None) -> bool:
        nonlocal passed
        if after is not None and after <= key:
            passed += entry.run.count
            return False
        return entry.first < key

    def dart(at: Key, d: Dart) -> bool:
        nonlocal passed
        passed += at < key
        return at >= key

    track.walk(enter, dart)
    return passed


class Line(NamedTuple):
    """State of one player: what remains in X01, points in Cricket."""

    value: int
    status: str
    throws: int


class Standing(NamedTuple):
    """Lines by player, and what a leg that is put away goes on from."""

    lines: dict[str | None, Line]
    saved: list


def x01_standing(tracks: dict[str | None, Track], start: int, saved: list | None) -> Standing:
    """The leg ends with the first finish of any player; what comes later does not count."""
    before, throws, over = _opening(saved)
    for name in tracks:
        before.setdefault(name, Player(start))
    ends = [] if over else [x01_finish(t, before[name]) for name, t in tracks.items()]
    end = min((e for e in ends if e is not None), default=None)
    lines, rows = {}, []
    for name, p in before.items():
        n = throws.get(name, 0)
        if name in tracks:
            n += tracks[name].count
            if over:
                p.status = "after"
            elif x01_until(tracks[name], p, end):
                p.status = "after"
        lines[name] = Line(p.left, p.status, n)
        rows.append([name, p.left, p.status, n, p.turn, p.darts, p.base])
    return Standing(lines, [rows, over or end is not None])


def _opening(saved: list | None) -> tuple[dict[str | None, Player], dict[str | None, int], bool]:
    """The players where an X01 leg was put away, their throws, and whether it was over."""
    before, throws, over = {}, {}, False
    if saved is not None:
        rows, over = saved
        for name, left, status, n, turn, darts, base in rows:
            before[name], throws[name] = Player(left, status, turn, darts, base), n
    return before, throws, over


def x01_fold(darts: Iterable[tuple[str | None, Dart]], start: int, double_out: bool, saved: list | None) -> Standing:
    """`x01_standing` of a leg of few darts, given in order: one after the other, without a tree."""
    players, throws, over = _opening(saved)
    for name, d in darts:
        p = players.get(name)
        if p is None:
            p = players[name] = Player(start)
        throws[name] = throws.get(name, 0) + 1
        if over:
            p.status = "after"
        else:
            had = p.left
            p.add(d, double_out)
            over = p.left == 0 < had
    lines = {name: Line(p.left, p.status, throws[name]) for name, p in players.items()}
    rows = [[name, p.left, p.status, throws[name], p.turn, p.darts, p.base] for name, p in players.items()]
    return Standing(lines, [rows, over])


def cricket_fold(darts: list[tuple[str | None, Dart]], saved: list | None) -> Standing:
    """`cricket_standing` of a leg of few darts, given in order: one after the other, without a tree."""
    rows, winner, over = saved if saved is not None else ((), None, False)
    points, throws, marks = {}, {}, {}
    for name, had, n, seen in rows:
        points[name], throws[name], marks[name] = had, n, list(seen)
    for name, _ in darts:
        if name not in marks:
            points[name], throws[name], marks[name] = 0, 0, [0] * len(CRICKET_NUMBERS)
    for name, d in darts:
        throws[name] += 1
        if over:
            continue
        own = marks[name]
        if d.segment in CRICKET_NUMBERS:
            k = CRICKET_NUMBERS.index(d.segment)
            beyond = max(own[k] + d.multiplier - 3, 0) - max(own[k] - 3, 0)
            own[k] += d.multiplier
            if beyond and any(marks[o][k] < 3 for o in marks if o != name):
                points[name] += d.segment * beyond
        if min(own) >= 3 and all(points[name] >= points[o] for o in marks):
            over, winner = True, name
    lines = {n: Line(points[n], "winner" if over and n == winner else "playing", throws[n]) for n in marks}
    return Standing(lines, [[[n, points[n], throws[n], marks[n]] for n in marks], winner, over])


_START: Key = (-(1 << 63), "")


class _Marks:
    """Marks and points of the players of a Cricket leg at any dart."""

    def __init__(self, tracks: dict[str | None, Track], saved: list | None):
        self.tracks, self.throws, self.points0, self.marks0 = tracks, {}, {}, {}
        for name, points, n, marks in saved[0] if saved else ():
            self.points0[name], self.throws[name], self.marks0[name] = points, n, marks
        for name in tracks:
            if name not in self.marks0:
                self.points0[name], self.throws[name], self.marks0[name] = 0, 0, [0] * len(CRICKET_NUMBERS)
        self.names = list(self.marks0)
        self.closed = {n: [self._closing(n, k) for k in range(len(CRICKET_NUMBERS))] for n in self.names}
        # Until when a player scores on a number: the last opponent's closing; None: for ever.
        self.until = {n: [self._last(n, k) for k in range(len(CRICKET_NUMBERS))] for n in self.names}

    def _closing(self, name, k) -> Key | None:
        had = self.marks0[name][k]
        if had >= 3:
            return _START
        track = self.tracks.get(name)
        if track is None or had + track.root.run.marks[k] < 3:
            return None
        return marks_reached(track, k, 3 - had)

    def _last(self, name, k) -> Key | None:
        others = [self.closed[o][k] for o in self.names if o != name]
        return None if None in others else max(others, default=_START)

    def marks(self, name, at: Key | None) -> list[int]:
        had = self.marks0[name]
        new = marks_until(self.tracks[name], at) if name in self.tracks else [0] * len(had)
        return [a + b for a, b in zip(had, new)]

    def score(self, name, at: Key | None) -> int:
        """Points after the dart `at` (None: the last)."""
        total, known = self.points0[name], {}
        for k, number in enumerate(CRICKET_NUMBERS):
            last = self.until[name][k]
            end = at if last is None else last if at is None else min(at, last)
            if end not in known:
                known[end] = self.marks(name, end)
            total += number * (max(known[end][k] - 3, 0) - max(self.marks0[name][k] - 3, 0))
        return total

    def best_other(self, name, at: Key) -> int:
        return max((self.score(o, at) for o in self.names if o != name), default=0)

    def win(self, name) -> Key | None:
        """The dart with which a player has closed everything and at least as many points as all others."""
        track = self.tracks.get(name)
        if track is None or None in self.closed[name]:
            return None
        at = max(self.closed[name])
        if at == _START:
            rank, need = 0, self.best_other(name, at)
        else:
            rank, need = rank_of(track, at), self.best_other(name, at)
            if self.score(name, at) >= need:
                return at
        # Points only grow, so look for the first dart with enough; others may have more by then.
        while True:
            low, high = rank, track.count
            while low < high:
                middle = (low + high) // 2
                if self.score(name, key_at(track, middle)) >= need:
                    high = middle
                else:
                    low = middle + 1
            if low == track.count:
                return None
            at = key_at(track, low)
            now = self.best_other(name, at)
            if self.score(name, at) >= now:
                return at
            rank, need = low, now


def cricket_standing(tracks: dict[str | None, Track], saved: list | None) -> Standing:
    """The leg ends with the first player who has closed everything and is not behind."""
    m = _Marks(tracks, saved)
    winner, end, over = (saved[1], None, saved[2]) if saved else (None, None, False)
    if not over:
        wins = [(key, name) for name in m.names if (key := m.win(name)) is not None]
        if wins:
            end, winner = min(wins, key=lambda w: w[0])
            over = True
    else:
        end = _START
    lines, rows = {}, []
    for name in m.names:
        n = m.throws[name] + (tracks[name].count if name in tracks else 0)
        points = m.score(name, end)
        lines[name] = Line(points, "winner" if over and name == winner else "playing", n)
        rows.append([name, points, n, m.marks(name, end)])
    return Standing(lines, [rows, winner, over])
