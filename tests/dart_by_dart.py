"""X01 and Cricket dart by dart, to hold the library against.

A leg can be put away as JSON and taken up again, so that a session that was
closed goes on where it stood.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from ocheline.schemas import CRICKET_NUMBERS


class Throw(NamedTuple):
    at: int
    id: str
    player: str
    segment: int
    multiplier: int
    turn: str | None = None


class Line(NamedTuple):
    """State of one player: what remains in X01, points in Cricket."""

    value: int
    status: str
    throws: int


class X01:
    """A turn ends after three darts or where its id changes."""

    def __init__(self, start: int, double_out: bool, saved: str | None = None):
        self.start, self.double_out = start, double_out
        # By player: left, status, throws, and the turn's id, darts and score at its start.
        self.players: dict[str, list] = {}
        self.over = False
        if saved is not None:
            self.players, self.over = json.loads(saved)

    def add(self, t: Throw) -> None:
        p = self.players.setdefault(t.player, [self.start, "", 0, None, 3, self.start])
        left, status, throws, id, darts, base = p
        if darts == 3 or id != t.turn:
            darts, base = 0, left
        p[2:] = [throws + 1, t.turn, darts + 1, base]
        if self.over:
            p[1] = "after"
            return
        if darts > 0 and status in ("bust", "void"):
            p[1] = "void"
            return
        rest = left - t.segment * t.multiplier
        if rest == 0 and (t.multiplier == 2 or not self.double_out):
            p[:2] = [0, "finish"]
            self.over = True
        elif rest <= 0 or (rest == 1 and self.double_out):
            p[:2] = [base, "bust"]
        else:
            p[:2] = [rest, "scored"]

    def lines(self) -> dict[str, Line]:
        return {name: Line(*p[:3]) for name, p in self.players.items()}

    def saved(self) -> str:
        return json.dumps([self.players, self.over])


class Cricket:
    """A player counts as opponent from the start of the leg, so all are named first."""

    def __init__(self, players: Sequence[str], saved: str | None = None):
        # By player: points, throws, marks of the numbers in order.
        self.players: dict[str, list] = {}
        self.winner = None
        if saved is not None:
            self.players, self.winner = json.loads(saved)
        for name in players:
            self.players.setdefault(name, [0, 0, [0] * len(CRICKET_NUMBERS)])

    def add(self, t: Throw) -> None:
        mine = self.players[t.player]
        mine[1] += 1
        if self.winner is not None or t.segment not in CRICKET_NUMBERS:
            return
        k = CRICKET_NUMBERS.index(t.segment)
        before = mine[2][k]
        mine[2][k] += t.multiplier
        surplus = max(mine[2][k] - 3, 0) - max(before - 3, 0)
        if any(p[2][k] < 3 for name, p in self.players.items() if name != t.player):
            mine[0] += surplus * t.segment
        if min(mine[2]) >= 3 and mine[0] >= max(p[0] for p in self.players.values()):
            self.winner = t.player

    def lines(self) -> dict[str, Line]:
        return {
            name: Line(p[0], "winner" if name == self.winner else "playing", p[1])
            for name, p in self.players.items()
        }

    def saved(self) -> str:
        return json.dumps([self.players, self.winner])


def play(
    game: str, throws: Sequence[Throw], start: int, double_out: bool, saved: str | None = None
) -> X01 | Cricket:
    """The leg after `throws`, in order, from where it was saved."""
    if game == "X01":
        leg = X01(start, double_out, saved)
    else:
        leg = Cricket(list(dict.fromkeys(t.player for t in throws)), saved)
    for t in throws:
        leg.add(t)
    return leg


def x01(throws: Sequence[Throw], start: int, double_out: bool) -> dict[str, Line]:
    return play("X01", throws, start, double_out).lines()


def cricket(throws: Sequence[Throw]) -> dict[str, Line]:
    return play("Cricket", throws, 0, False).lines()
