"""Ticket bodies and the frontier, by hand."""

import make
from pyspark.sql import functions as F

from ocheline import schemas
from ocheline.operators import issues

HEAD = "Parent map: #1\nType: wayfinder:{kind}\nBlocked by: {by}\n\n## Question\n\nWhy?\n"


def ticket(n, state="open", by="none", assignee=None, title="[Wayfinder Task] t", body=None, parent=None, blockers=None):
    text = HEAD.format(kind="task", by=by) if body is None else body
    return ("r", n, title, state, assignee, text, parent, blockers)


def table(spark, rows):
    return spark.createDataFrame(rows, schemas.ISSUES)


def test_kinds(spark):
    titles = ["[Wayfinder Map] x", "[Wayfinder Research] x", "[Wayfinder Grilling] y", "Wayfinder Task", "x [Wayfinder Task]", None]
    rows = [ticket(i, title=t) for i, t in enumerate(titles)]
    found = {r.number: r.kind for r in issues.classify_issues(table(spark, rows)).collect()}
    assert found == {0: "map", 1: "research", 2: "grilling", 3: None, 4: None, 5: None}


def test_body_lines(spark):
    rows = [
        ticket(2, by="none"),
        ticket(3, by="#12, #7, #7"),
        ticket(4, body="text only"),
        ticket(5, body=None if False else "Blocked by: #9\nParent map: #x"),
    ]
    found = {r.number: (r.parent, r.ticket_type, r.blockers) for r in issues.parse_ticket(table(spark, rows)).collect()}
    assert found == {2: (1, "task", []), 3: (1, "task", [12, 7]), 4: (None, None, []), 5: (None, None, [9])}


def test_frontier(spark):
    rows = [
        ticket(1, title="[Wayfinder Map] m", body="## Destination\n"),
        ticket(2),
        ticket(3, state="closed"),
        ticket(4, by="#3"),
        ticket(5, by="#3, #2"),
        ticket(6, by="#99"),
        ticket(7, assignee="me"),
        ticket(8, by="#2", blockers=[3]),
        ticket(9, by="none", blockers=[2]),
        ticket(10, blockers=[]),
    ]
    assert sorted(r.number for r in issues.frontier(table(spark, rows)).collect()) == [2, 4, 8, 10]


def test_native_parent_wins(spark):
    rows = [ticket(2), ticket(3, parent=7), ticket(4, body="")]
    assert {r.number: r.parent for r in issues.parents(table(spark, rows)).collect()} == {2: 1, 3: 7}
    progress = issues.map_progress(table(spark, rows + [ticket(5, state="closed", parent=7), ticket(6, state="closed", parent=8)]))
    assert {r.parent: (r.tickets, r.open_tickets, r.settled) for r in progress.collect()} == {1: (1, 1, False), 7: (2, 1, False), 8: (1, 0, True)}


def test_questions_and_sections(spark):
    two = HEAD.format(kind="task", by="none") + "\n## Question  \n"
    rows = [ticket(2), ticket(3, body=two), ticket(4, body="### Question\n## Questions\n")]
    assert {r.number: r.n_questions for r in issues.bad_questions(table(spark, rows)).collect()} == {3: 2, 4: 0}
    whole = "".join(f"## {s}\n\nx\n" for s in issues.SECTIONS)
    maps = [ticket(1, title="[Wayfinder Map] a", body=whole), ticket(2, title="[Wayfinder Map] b", body="## Notes\n##Destination\n")]
    found = issues.map_sections(table(spark, maps)).collect()
    assert [(r.number, r.missing) for r in found] == [(2, ["Destination", "Decisions so far", "Not yet specified", "Out of scope"])]


def test_claims(spark):
    acts = [(2, 1, "assigned"), (2, 5, "commit"), (3, 1, "commit"), (3, 2, "assigned"), (4, 1, "commit"), (5, 1, "assigned")]
    activity = spark.createDataFrame([("r", n, make.at(t), k) for n, t, k in acts], "repo string, number bigint, ts timestamp, kind string")
    rows = [ticket(n) for n in (2, 3, 4, 5)]
    assert sorted(r.number for r in issues.claim_audit(table(spark, rows), activity).collect()) == [3, 4]


def test_resolutions(spark):
    body = (
        "## Decisions so far\n\n- [#2](u) use files\n- #4: Because of A.\n  And of B.\n- see #5\n- #4 again, unlike #6\n"
        "## Not yet specified\n\n- #6 Because\n"
    )
    rows = [ticket(1, title="[Wayfinder Map] m", body=body)] + [ticket(n, state="closed") for n in (2, 3, 4, 5, 6)] + [ticket(7)]
    notes = [(2, "resolution", "We use files since they are simple."), (4, "resolution", "Because of A.\n  And of B."), (5, "comment", "hm"), (6, "resolution", "Because")]
    comments = spark.createDataFrame([("r", n, make.at(0), k, t) for n, k, t in notes], "repo string, number bigint, ts timestamp, kind string, text string")
    found = {(r.number, r.fault) for r in issues.resolution_audit(table(spark, rows), comments).collect()}
    assert found == {(3, "no_resolution"), (5, "no_resolution"), (3, "not_in_map"), (6, "not_in_map"), (4, "pasted")}


def test_branches(spark):
    names = ["prototype/tips", "prototype/a/b", "prototype/", "feature/x", "xprototype/y"]
    df = spark.createDataFrame([("r", n) for n in names], "repo string, name string")
    assert {r.name for r in issues.branch_audit(df).collect()} == set(names[1:])
    only = issues.branch_audit(df, df.filter(F.col("name").startswith("prototype")))
    assert {r.name for r in only.collect()} == {"prototype/a/b", "prototype/"}
