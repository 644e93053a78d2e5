"""Small throw tables for tests."""

from __future__ import annotations

import datetime as dt

from ocheline import schemas

START = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(second: float) -> dt.datetime:
    return START + dt.timedelta(seconds=second)


def notation(segment: int, multiplier: int) -> str:
    if segment == 0:
        return "MISS"
    if segment == 25:
        return {1: "SB", 2: "DB"}[multiplier]
    return "SDT"[multiplier - 1] + str(segment)


def parse(text: str) -> tuple[int, int]:
    fixed = {"MISS": (0, 0), "SB": (25, 1), "DB": (25, 2)}
    return fixed.get(text) or (int(text[1:]), "SDT".index(text[0]) + 1)


def throw(id, what="MISS", player="a", session="s", second=None, of=None, **other) -> dict:
    segment, multiplier = parse(what)
    row = {
        "id": str(id),
        "session_id": session,
        "player_id": player,
        "turn_id": None,
        "captured_at": at(float(id) if second is None else second),
        "x": 0.1,
        "y": 0.2,
        "segment": segment,
        "multiplier": multiplier,
        "score": segment * multiplier,
        "notation": what,
        "confidence": 0.9,
        "calibration_id": "c",
        "source": "camera" if of is None else "manual-correction",
        "correction_of": None if of is None else str(of),
    }
    return {**row, **other}


def table(spark, rows):
    names = schemas.THROWS.fieldNames()
    return spark.createDataFrame([[r[n] for n in names] for r in rows], schemas.THROWS)


def game(spark, kind="X01", start=501, double_out=True, sessions=("s",), started=START):
    rows = [(s, kind, start, double_out, started) for s in sessions]
    return spark.createDataFrame(rows, schemas.GAMES)
