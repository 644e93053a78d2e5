"""Jobs over dumps of decision tickets, keyed by (repo, number)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title prefixes, body lines, headings and branch names.
TITLE = r"^\[Wayfinder (Map|Research|Prototype|Grilling|Task)\]"
PARENT = r"(?m)^Parent map: #(\d+)\s*$"
TYPE = r"(?m)^Type: wayfinder:(\w+)\s*$"
BLOCKED = r"(?m)^Blocked by: (.*)$"
QUESTION = r"(?m)^## Question[ \t]*$"
SECTIONS = [
    "Destination",
    "Notes",
    "Decisions so far",
    "Not yet specified",
    "Out of scope",
]
PROTOTYPE_BRANCH = r"^prototype/[^/]+$"

TICKET = ["repo", "number"]


def classify_issues(issues: DataFrame) -> DataFrame:
    """Kind from the title prefix, null where there is none."""
    kind = F.lower(F.regexp_extract(F.col("title"), TITLE, 1))
    return issues.withColumn("kind", F.nullif(kind, F.lit("")))


def _parent_line() -> Column:
    return F.regexp_extract(F.col("body"), PARENT, 1).try_cast("bigint")


def _parent() -> Column:
    return F.coalesce("native_parent", _parent_line())


def _blocker_numbers() -> Column:
    listed = F.regexp_extract(F.col("body"), BLOCKED, 1)
    numbers = F.regexp_extract_all(listed, F.lit(r"#(\d+)"), F.lit(1))
    return F.array_distinct(F.transform(numbers, lambda n: n.try_cast("bigint")))


def parse_ticket(issues: DataFrame) -> DataFrame:
    """Parent, type and blockers as the body states them."""
    return issues.withColumns(
        {
            "parent": _parent_line(),
            "ticket_type": F.nullif(F.regexp_extract(F.col("body"), TYPE, 1), F.lit("")),
            "blockers": _blocker_numbers(),
        }
    )


def tickets(issues: DataFrame) -> DataFrame:
    """Issues whose title marks them as decision tickets."""
    return classify_issues(issues).filter(F.col("kind") != "map")


def bad_questions(issues: DataFrame) -> DataFrame:
    """Tickets without exactly one question heading."""
    n = F.regexp_count(F.coalesce("body", F.lit("")), F.lit(QUESTION))
    return tickets(issues).withColumn("n_questions", n).filter(F.col("n_questions") != 1)


def map_sections(issues: DataFrame) -> DataFrame:
    """I4: maps that lack one of the five sections, and which."""
    expected = F.array(*[F.lit(s) for s in SECTIONS])
    found = F.regexp_extract_all(
        F.coalesce("body", F.lit("")), F.lit(r"(?m)^## ([^\n]*?)[ \t]*$"), F.lit(1)
    )
    maps = classify_issues(issues).filter(F.col("kind") == "map")
    return maps.withColumn("missing", F.array_except(expected, found)).filter(
        F.size("missing") > 0
    )


def parents(issues: DataFrame) -> DataFrame:
    """Parent edge of each issue: the native one, else the body line."""
    return issues.select(*TICKET, _parent().alias("parent")).filter(F.col("parent").isNotNull())


def blocking_edges(issues: DataFrame) -> DataFrame:
    """Blockers of each issue: the native ones, else the body line."""
    blockers = F.coalesce("native_blockers", _blocker_numbers())
    return issues.select(*TICKET, F.explode(F.array_distinct(blockers)).alias("blocker"))


def frontier(issues: DataFrame) -> DataFrame:
    """Open, unassigned tickets all of whose blockers are closed.

    A blocker that is not in the table counts as not closed.
    """
    closed = issues.filter(F.col("state") == "closed").select(
        "repo", F.col("number").alias("blocker")
    )
    available = tickets(issues).filter((F.col("state") == "open") & F.col("assignee").isNull())
    blocked = (
        blocking_edges(available).join(closed, ["repo", "blocker"], "left_anti").select(*TICKET)
    )
    return available.join(blocked, TICKET, "left_anti")


def claim_audit(issues: DataFrame, activity: DataFrame) -> DataFrame:
    """I8: tickets on which work was recorded before they were assigned.

    `activity` has (repo, number, ts, kind), with kind 'assigned' for claims. A
    ticket with work and no claim at all is listed with a null claim.
    """
    claim = F.col("kind") == "assigned"
    per_ticket = activity.groupBy(*TICKET).agg(
        F.min(F.when(claim, F.col("ts"))).alias("assigned_at"),
        F.min(F.when(~claim, F.col("ts"))).alias("first_work"),
    )
    early = F.col("first_work").isNotNull() & (
        F.col("assigned_at").isNull() | (F.col("first_work") < F.col("assigned_at"))
    )
    return per_ticket.filter(early).join(tickets(issues).select(*TICKET), TICKET, "left_semi")


def map_decisions(issues: DataFrame) -> DataFrame:
    """Entries under 'Decisions so far' of each map, with the ticket each is about."""
    # The section up to the next heading, then its bullets with what is indented below.
    section = F.regexp_extract(
        F.col("body"), r"(?ms)^## Decisions so far[ \t]*$(.*?)(?=^## |\z)", 1
    )
    entries = F.filter(F.split(section, r"(?m)^- "), lambda e: F.trim(e) != "")
    maps = classify_issues(issues).filter(F.col("kind") == "map")
    lines = maps.select("repo", F.col("number").alias("parent"), F.explode(entries).alias("entry"))
    linked = F.regexp_extract_all(F.col("entry"), F.lit(r"#(\d+)"), F.lit(1))
    # An entry is about the ticket it links first; others are mentioned.
    return lines.withColumn("number", F.get(linked, F.lit(0)).try_cast("bigint")).filter(
        F.col("number").isNotNull()
    )


def resolution_audit(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Closed tickets that were not resolved as agreed, with the fault.

    'no_resolution': no resolution comment; 'not_in_map': no entry in the map;
    'pasted': an entry holds a whole resolution of the ticket.
    """
    closed = (
        tickets(issues).filter(F.col("state") == "closed").select(*TICKET, _parent().alias("parent"))
    )
    resolutions = (
        comments.filter(F.col("kind") == "resolution")
        .select(*TICKET, F.trim("text").alias("text"))
        .distinct()
    )
    holds = (F.col("text") != "") & F.col("entry").contains(F.col("text"))
    looked_up = (
        closed.join(resolutions, TICKET, "left")
        .join(map_decisions(issues), ["repo", "number", "parent"], "left")
        .groupBy(*TICKET)
        .agg(
            F.bool_or(F.col("text").isNotNull()).alias("resolved"),
            F.bool_or(F.col("entry").isNotNull()).alias("listed"),
            F.bool_or(F.coalesce(holds, F.lit(False))).alias("pasted"),
        )
    )
    faults = F.array_compact(
        F.array(
            F.when(~F.col("resolved"), "no_resolution"),
            F.when(~F.col("listed"), "not_in_map"),
            F.when(F.col("pasted"), "pasted"),
        )
    )
    return looked_up.select(*TICKET, F.explode(faults).alias("fault"))


def branch_audit(branches: DataFrame, prototypes: DataFrame | None = None) -> DataFrame:
    """Branches not named prototype/<short-name>.

    With `prototypes` (repo, name) only those branches are looked at.
    """
    if prototypes is not None:
        branches = branches.join(prototypes, ["repo", "name"], "left_semi")
    return branches.filter(~F.col("name").rlike(PROTOTYPE_BRANCH))


def map_progress(issues: DataFrame) -> DataFrame:
    """Open and closed tickets per map, and whether the map is settled."""
    return (
        tickets(issues)
        .select("repo", _parent().alias("parent"), "state")
        .filter(F.col("parent").isNotNull())
        .groupBy("repo", "parent")
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.count_if(F.col("state") == "open").alias("open_tickets"),
        )
        .withColumn("settled", F.col("open_tickets") == 0)
    )
