"""URL filter: rules by host and path, and trust that spreads over links between hosts.

Hosts that an allow rule fits are trusted seeds, hosts that a block rule fits
blocked ones. Trust is the personalised PageRank of the trusted seeds along the
links, distrust that of the blocked seeds against them (who links to bad hosts
is suspect). Links are those of the pages, counted once for each pair of hosts,
and one between each host and its parent domain, in both directions, since a
subdomain is its owner's. A host without rule is blocked if its distrust is
above its trust and above a share of 1 / hosts, which is what each would have if
all distrust were spread evenly; so the bound means the same among any number.

Scores are the sums of what reaches a host over 0, 1, 2, … links. All that goes
over more than ROUNDS links is less than TOLERANCE together, in any graph, and is
left out.

Everything is DataFrame operations. Links are added up per pair of hosts before
they are shuffled; scores are joined to links by host and added up by host.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocheline.llm.frames import unused
from ocheline.plans.storage import cut_lineage

DAMPING = 0.85
TOLERANCE = 1e-5
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
# Share of the even distrust that a blocked host has at least.
THRESHOLD = 0.06
# Scores are written each so many rounds, so that plans stay short.
CUT_EVERY = 6


@dataclass(frozen=True)
class Rule:
    """`verdict` for urls whose host is `host` or below it and whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules, the path with its slash.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host then path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest text first: of two rules that fit one url it is the more special one.
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): how often pages of one host link to another, parents included.

    Links are href values with a host of their own; relative ones stay on the
    host and are left out, as are empty hosts.
    """
    host = host_of(F.col(url_col))
    hrefs = F.regexp_extract_all(
        F.coalesce(html_col, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)")
    )
    each = pages.select(host.alias("src"), F.explode(hrefs).alias("href"))
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href"))
    linked = each.select("src", host_of(target).alias("dst")).groupBy("src", "dst").agg(
        F.count("*").alias("n")
    )
    # Every host with a dot has the parent domain as a neighbour, up to the top.
    names = pages.select(host.alias("h")).distinct()
    labels = F.split("h", r"\.")
    chain = names.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
            )
        ).alias("h")
    ).distinct()
    parent = chain.where(F.instr("h", ".") > 0).select(
        F.col("h").alias("src"), F.regexp_replace("h", r"^[^.]*\.", "").alias("dst"), F.lit(1).cast("long").alias("n")
    )
    # Top-level names are nobody's, so nothing spreads through them.
    sites = parent.where(F.instr("dst", ".") > 0)
    back = sites.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return (
        linked.unionByName(sites)
        .unionByName(back)
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.sum("n").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score): personalised PageRank of `seeds` (kind, host, weight) along `links` (kind, src, dst, n).

    Each kind is a graph with seeds of its own; all are worked off together.
    Weights are scaled to a sum of 1 for each kind. What reaches a host without
    links of its own is not handed on. Without seeds the result is empty.
    """
    out = links.groupBy(F.col("kind").alias("_kind"), F.col("src").alias("_src")).agg(F.sum("n").alias("_all"))
    shares = cut_lineage(
        links.join(out, (F.col("kind") == F.col("_kind")) & (F.col("src") == F.col("_src"))).select(
            F.col("kind").alias("_kind"), "src", "dst", (F.col("n") / F.col("_all")).alias("share")
        )
    )
    total = seeds.groupBy(F.col("kind").alias("_kind")).agg(F.sum("weight").alias("_total"))
    restart = cut_lineage(
        seeds.join(total, F.col("kind") == F.col("_kind")).select(
            "kind", "host", (F.col("weight") / F.col("_total") * (1 - damping)).alias("score")
        )
    )
    rank = restart
    for k in range(1, rounds + 1):
        moved = rank.join(shares, (F.col("kind") == F.col("_kind")) & (F.col("host") == F.col("src"))).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        rank = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % CUT_EVERY == 0 or k == rounds:
            rank = cut_lineage(rank)
    return rank


def judge(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    url_col: str = "url",
    html_col: str = "html",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """`pages` with host, path, rule, verdict, trust and distrust; clashing columns are replaced.

    A rule decides where one fits; else the method does: a host is blocked if
    its distrust is above its trust and above `threshold` / hosts, for the number
    of hosts of `pages`. Null urls and those
    without :// have an empty host and path, no rule, and are allowed, since
    nothing is known against them. Repeated rows are judged alike but count as
    more pages of their host. An empty table gives an empty result.
    """
    added = ("host", "path", "rule", "verdict", "trust", "distrust")
    url = F.col(url_col)
    narrow = pages.select(
        host_of(url).alias("h"), path_of(url).alias("p"), url.alias("u"), F.col(html_col).alias("html")
    )
    _, verdict = rule_for(F.col("h"), F.col("p"), rules)
    seeds = cut_lineage(
        narrow.select("h", verdict.alias("v"))
        .where("h <> '' and v is not null")
        .groupBy(F.col("h").alias("host"), F.col("v").alias("kind"))
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = narrow.where("h <> ''").agg(F.countDistinct("h")).first()[0]
    bound = threshold / max(1, hosts)
    along = cut_lineage(host_links(narrow, "u", "html")).withColumn("kind", F.lit("allow"))
    against = along.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    found = spread(along.unionByName(against), seeds)
    mark, known, t, d = (unused(pages, n) for n in ("_h", "_host", "_t", "_d"))
    scores = found.groupBy(F.col("host").alias(known)).agg(
        F.max(F.when(F.col("kind") == "allow", F.col("score"))).alias(t),
        F.max(F.when(F.col("kind") == "block", F.col("score"))).alias(d),
    )
    joined = pages.withColumn(mark, host_of(url)).join(scores, F.col(mark) == F.col(known), "left")
    rule, verdict = rule_for(F.col(mark), path_of(url), rules)
    trust, distrust = F.coalesce(t, F.lit(0.0)), F.coalesce(d, F.lit(0.0))
    method = F.when((distrust > bound) & (distrust > trust), "block").otherwise("allow")
    return joined.select(
        *[pages[c] for c in pages.columns if c not in added],
        F.col(mark).alias("host"),
        path_of(url).alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
