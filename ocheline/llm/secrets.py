"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean trigram query is derived: an OR of ANDs of
trigrams without which the pattern cannot match. Postings (trigram, document)
of the trigrams that any query names are written as a table; a rule's
candidates are the documents that hold all trigrams of one AND. The pattern
itself runs on candidates only. A rule without mandatory trigrams runs on every
document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocheline.llm.frames import unused
from ocheline.plans.storage import cut_lineage

# A pattern with more alternatives than this is scanned fully.
MAX_ALTERNATIVES = 64
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; then those too short are dropped.

    `least` is the number of characters that `group` (0: the match) must have.
    The pattern's last part must be `group` if that is not 0.
    """

    kind: str
    pattern: str
    group: int
    least: int


# The three base rules, then what is found besides.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    Rule("assign", ASSIGN, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs of 16 and more are the same as all runs without the short ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1),
)


def literals(pattern: str) -> list[list[str]]:
    """Alternatives of literal strings, all of which a match of the alternative holds.

    Lower case. An alternative without strings means that nothing is mandatory.
    """

    def walk(nodes, states: list[tuple[tuple[str, ...], str]]):
        for code, value in nodes:
            if code is op.LITERAL:
                states = [(done, open_ + chr(value).lower()) for done, open_ in states]
            elif code is op.SUBPATTERN:
                states = walk(value[3], states)
            elif code is op.BRANCH:
                states = [s for branch in value[1] for s in walk(branch, states)]
            elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[:2] == (0, 1):
                if value[2][0][0] is op.IN:
                    states = [(done + (open_,), "") for done, open_ in states]
                else:
                    states = states + walk(value[2], states)
            elif code is op.AT:
                continue
            else:
                states = [(done + (open_,), "") for done, open_ in states]
            if len(states) > MAX_ALTERNATIVES:
                states = [((), "")]
        return states

    return [[*done, open_] for done, open_ in walk(parser.parse(pattern), [((), "")])]


def trigram_query(pattern: str) -> list[set[str]]:
    """The pattern's OR of ANDs; empty if some alternative has no trigram."""
    query = [{t[i : i + 3] for t in texts for i in range(len(t) - 2)} for texts in literals(pattern)]
    return query if all(query) else []


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(_cid, _rules): ids and the indexed rules whose trigram query they fulfil."""
    spark = docs.sparkSession
    wanted = [
        (r.kind, k, gram)
        for r in rules
        for k, grams in enumerate(trigram_query(r.pattern))
        for gram in sorted(grams)
    ]
    grams = sorted({w[2] for w in wanted})
    held = _once(
        F.lower(F.col(text_col)),
        lambda low: F.array_compact(
            F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])
        ),
    )
    postings = cut_lineage(
        docs.select(F.col(id_col).alias("id"), F.explode(held).alias("gram"))
        if grams
        else docs.select(F.col(id_col).alias("id"), F.lit("").alias("gram")).limit(0)
    )
    queries = spark.createDataFrame(
        [(kind, k, g, sum(w[:2] == (kind, k) for w in wanted)) for kind, k, g in wanted],
        "rule string, part int, gram string, needed int",
    )
    return (
        postings.distinct()
        .join(F.broadcast(queries), "gram")  # the rules' own trigrams, a few dozen
        .groupBy("rule", "part", "id")
        .agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
        .where("n = needed")
        .groupBy(F.col("id").alias("_cid"))
        .agg(F.collect_set("rule").alias("_rules"))
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _chunks(items: Column) -> Column:
    """An array that is not empty, cut into about as many chunks as a chunk has items."""
    step = F.ceil(F.sqrt(F.size(items))).cast("int")
    count = F.ceil(F.size(items) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(items, k * step + 1, step))


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of some numbers, what `combine` makes of 0 and all those before it.

    A fold that appends to an array copies it each time, so only short arrays
    grow: the folds of whole chunks, and those within a chunk.
    """

    def walk(over: Column, first: Column) -> Column:
        return F.aggregate(
            over,
            F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(
                combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
        )["out"]

    def all_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), combine))
        return F.flatten(F.zip_with(chunks, walk(totals, F.lit(0)), walk))

    return F.when(F.size(values) > 0, _once(_chunks(values), all_chunks)).otherwise(F.array().cast("array<int>"))


def _spans(rule: Rule, text: Column, run: Column) -> Column:
    """Array of (start, end) of a rule's matches in code points."""
    pattern = F.lit(rule.pattern)
    nothing = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def place(matches: Column) -> Column:
        judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
        # What lies before each match; the rest of the text is left out.
        parts = F.zip_with(
            F.arrays_zip(matches.alias("m"), judged.alias("j")),
            F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches)),
            lambda m, gap: F.struct(
                F.length(gap).alias("gap"),
                (F.length(gap) + F.length(m["m"])).alias("size"),
                (F.length(m["j"]) >= rule.least).alias("ok"),
            ),
        )

        def placed(parts: Column) -> Column:
            before = _before(F.transform(parts, lambda p: p["size"]), lambda x, y: x + y)
            found = F.zip_with(
                parts,
                before,
                lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["size"]).alias("end"), p["ok"].alias("ok")),
            )
            return F.transform(
                F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
            )

        # The text is not split where there is nothing to place.
        return F.when(F.size(matches) > 0, _once(parts, placed)).otherwise(empty)

    return _once(F.when(run, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(nothing), place)


def _named(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["start"].alias("start"),
        F.lit(rank).alias("rank"),
        s["end"].alias("end"),
        F.lit(kind).alias("kind"),
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def with_spans(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE + MORE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, str]:
    """`docs` with an array column of (start, rank, end, kind) by start, then rule; and its name.

    Offsets are code points, the end exclusive. Null and empty texts have no
    spans. Repeated ids share candidates, never spans; rows without an id are
    joined to candidates without one. Rows stay one to one.
    """
    result = unused(docs, "_spans")
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    found = candidates(docs, rules, id_col, text_col)
    held = unused(docs, "_rules")
    found = found.withColumnRenamed("_rules", held)
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_cid"]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = []
    for rank, rule in enumerate(rules):
        run = (
            F.coalesce(F.array_contains(held, rule.kind), F.lit(False))
            if rule.kind in indexed
            else F.lit(True)
        )
        each.append(
            F.transform(_spans(rule, text, run), _named(rank, rule.kind))
        )
    spans = F.array_sort(F.concat(*each))
    return joined.select(*[docs[c] for c in docs.columns], spans.alias(result)), result


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of `docs`."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked, name = with_spans(narrow, BASE + MORE, "id")
    spans = F.col(name)
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return marked.select(
        F.col("id").alias(id_col),
        *[
            F.size(F.filter(spans, _is(r.kind))).cast("long").alias(f"n_{r.kind}")
            for r in BASE
        ],
        F.sha2(spelt(base).cast("binary"), 256).alias("base_sha256"),
        spelt(spans).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of a secret put out of the text, overlapping ones as one.

    Texts without secrets and all other columns stay as they are.
    """
    marked, name = with_spans(docs, BASE + MORE, id_col, text_col)
    text = F.col(text_col)

    def kept(spans: Column) -> Column:
        """(begin, end) of what lies between the spans, the rest of the text included."""
        ends = F.transform(spans, lambda s: s["end"])
        between = F.zip_with(
            spans, _before(ends, lambda x, y: F.greatest(x, y)), lambda s, at: F.struct(at.alias("begin"), s["start"].alias("end"))
        )
        rest = F.struct(F.array_max(ends).alias("begin"), F.length(text).alias("end"))
        return F.concat(F.filter(between, lambda p: p["end"] >= p["begin"]), F.array(rest))

    def spelt_out(part: Column) -> Column:
        """The texts of some neighbours; a place is looked for from the first one's on."""
        first = part[0]["begin"]
        return _once(
            F.substring(text, first + 1, F.element_at(part, -1)["end"] - first),
            lambda raw: F.transform(part, lambda p: F.substring(raw, p["begin"] - first + 1, p["end"] - p["begin"])),
        )

    texts = F.flatten(F.transform(_once(kept(F.col(name)), _chunks), spelt_out))
    masked = F.array_join(texts, MASK)
    new = F.when(F.size(name) > 0, masked).otherwise(text)
    return marked.withColumn(text_col, new).select(*docs.columns)
