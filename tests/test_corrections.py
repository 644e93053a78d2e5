"""Correction chains by hand and against a plain walk."""

import random

import make
import pytest

from ocheline.operators import corrections


def resolved(spark, rows):
    found = corrections.resolve_corrections(make.table(spark, rows)).collect()
    return {(r.root, r.final_id, r.n_steps, r.status) for r in found}


def test_none(spark):
    rows = [make.throw(1, "T20")]
    assert resolved(spark, rows) == set()
    t = make.table(spark, rows)
    assert [(r.id, r.notation, r.final_id) for r in corrections.effective_throws(t).collect()] == [("1", "T20", "1")]
    assert corrections.correction_lineage(t).count() == 0


def test_chain_of_three(spark):
    rows = [make.throw(1, "T20"), make.throw(2, "S1", of=1), make.throw(3, "S5", of=2), make.throw(4, "D5", of=3, player="z")]
    assert resolved(spark, rows) == {("1", "4", 3, "resolved")}
    (r,) = corrections.effective_throws(make.table(spark, rows)).collect()
    assert (r.id, r.notation, r.score, r.player_id, r.captured_at) == ("1", "D5", 10, "a", make.at(1))
    steps = corrections.correction_lineage(make.table(spark, rows)).orderBy("step").collect()
    assert [(s.root, s.step, s.id, s.notation) for s in steps] == [
        ("1", 0, "1", "T20"), ("1", 1, "2", "S1"), ("1", 2, "3", "S5"), ("1", 3, "4", "D5"),
    ]


def test_rivals_orphan_cycle_and_void(spark):
    rows = [
        make.throw(1, "T20"),
        make.throw(2, "S1", of=1),
        make.throw(3, "S5", of=1),
        make.throw(4, "S6", of=2),  # corrects the rival that lost
        make.throw(5, "S7", of="lost"),
        make.throw(6, "S8", of=7),
        make.throw(7, "S9", of=6),
        make.throw(8, "S10", of=8),
        make.throw(9, "T19"),
        make.throw(10, "MISS", of=9),
    ]
    found = resolved(spark, rows)
    assert found == {
        ("1", "3", 1, "resolved"),
        ("2", "4", 1, "superseded"),
        ("lost", "5", 1, "orphan"),
        (None, "6", None, "cycle"),
        (None, "7", None, "cycle"),
        (None, "8", None, "cycle"),
        ("9", "10", 1, "resolved"),
    }
    final = {r.id: r.notation for r in corrections.effective_throws(make.table(spark, rows)).collect()}
    assert final == {"1": "S5", "9": "MISS"}


def test_rivals_at_one_time_go_by_id(spark):
    rows = [make.throw(1), make.throw(2, "S1", of=1, second=9), make.throw(3, "S2", of=1, second=9)]
    assert resolved(spark, rows) == {("1", "3", 1, "resolved")}


@pytest.mark.parametrize("levels", [1, 3, 60])
def test_long_and_random_chains(spark, monkeypatch, levels):
    monkeypatch.setattr(corrections, "LEVELS", levels)
    rng = random.Random(5)
    rows = [make.throw(0, "S1")] + [make.throw(i, "S2", of=i - 1) for i in range(1, 40)]
    for i in range(100, 300):
        rows.append(make.throw(i, "S3", of=rng.choice([None, rng.randrange(100, 300), rng.randrange(i - 5, i)])))
    by_id = {r["id"]: r for r in rows}
    winner = {}
    for r in rows:
        if r["correction_of"] is not None:
            p = r["correction_of"]
            if p not in winner or (r["captured_at"], r["id"]) > (by_id[winner[p]]["captured_at"], winner[p]):
                winner[p] = r["id"]
    expected, on_path = set(), set()
    for start in {p for p in winner if p not in winner.values()}:
        end, n = start, 0
        while end in winner:
            end, n = winner[end], n + 1
            on_path.add(end)
        status = "orphan" if start not in by_id else "resolved" if by_id[start]["correction_of"] is None else "superseded"
        expected.add((start, end, n, status))
    expected |= {(None, i, None, "cycle") for i in winner.values() if i not in on_path}
    assert ("0", "39", 39, "resolved") in expected
    assert resolved(spark, rows) == expected
    # By recursion: chains within its levels, beyond them, and cycles.
    found = corrections.resolve_corrections(make.table(spark, rows), recursion=True).collect()
    assert {(r.root, r.final_id, r.n_steps, r.status) for r in found} == expected
    assert len(found) == len(expected)


def test_recursion_alone_follows_usual_chains(spark, monkeypatch):
    """Chains within the levels leave nothing to pointer doubling."""
    rows = [make.throw(0, "S1")] + [make.throw(i, "S2", of=i - 1) for i in range(1, 6)]
    monkeypatch.setattr(corrections, "_doubled", None)
    chains = corrections.follow_chains(make.table(spark, rows), recursion=True)
    assert {(r.id, r.root, r.step) for r in chains.links.collect()} == {(str(i), "0", i) for i in range(1, 6)}
    assert chains.cycles.count() == 0


def test_detected_next_to_corrected(spark):
    rows = [make.throw(1, "T20"), make.throw(2, "S1", of=1), make.throw(3, "S5"), make.throw(4, "S5", of=3)]
    found = {r.id: (r.detected_score, r.corrected_score, r.agree) for r in corrections.detected_vs_corrected(make.table(spark, rows)).collect()}
    assert found == {"1": (60, 1, False), "3": (5, 5, True)}


def test_history_holds_the_rivals_that_lost(spark):
    rows = [
        make.throw(1, "T20"),
        make.throw(2, "S1", of=1),
        make.throw(3, "S5", of=1),
        make.throw(4, "S6", of=2),  # corrects the rival that lost
        make.throw(5, "S7", of="lost"),
        make.throw(6, "S8", of=7),
        make.throw(7, "S9", of=6),
        make.throw(8, "S2", of=3),
    ]
    found = {(r.root, r.step, r.id, r.in_force) for r in corrections.correction_history(make.table(spark, rows)).collect()}
    assert found == {
        ("1", 0, "1", True), ("1", 1, "2", False), ("1", 1, "3", True), ("1", 2, "4", False), ("1", 2, "8", True),
        ("lost", 1, "5", True),
    }
