"""Turns, running scores, X01 and Cricket.

All windows and folds are keyed by the session first. For sessions of ordinary
size they share one shuffle; see `plans.ordered` for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocheline.plans.ordered import (
    as_of,
    hot_limit,
    is_split,
    over_groups,
    peak,
    previous,
    running,
    total,
)
from ocheline.plans.storage import cut_lineage
from ocheline.schemas import CRICKET_NUMBERS

ORDER = ["captured_at", "id"]
LEG = ["session_id", "started_at"]
DARTS = 3
# Turns folded in one row; a longer leg is folded piece by piece.
TURNS_PER_PIECE = 100
# Pieces whose effects are chained in one row.
PIECES_PER_STEP = 1000
# Throws that a caller's rules fold in one row.
THROWS_PER_FOLD = 100_000


# --- turns and totals -------------------------------------------------------


def _with_turns(df: DataFrame, keys: Sequence[str], given: bool) -> DataFrame:
    """Add turn_no (0, 1, …) and dart_no (1…3) per `keys`.

    A turn ends after three darts or where a given turn id changes. Where no
    turn ids are `given` this is floor((n - 1) / 3) over the throws in order.
    """
    count = total(F.lit(1))
    if not given:
        place = F.col("_n") - 1
        return (
            running(df, keys, ORDER, {"_n": count})
            .withColumns(
                {
                    "dart_no": (place % DARTS + 1).cast("int"),
                    "turn_no": F.floor(place / DARTS).cast("bigint"),
                }
            )
            .drop("_n")
        )
    before = previous(F.struct(F.col("turn_id").alias("t")))
    df = running(df, keys, ORDER, {"_n": count, "_before": before})
    opens = F.col("_before").isNull() | ~F.col("_before.t").eqNullSafe(F.col("turn_id"))
    df = running(
        df.withColumn("_open", F.when(opens, F.col("_n"))),
        keys,
        ORDER,
        {"_start": peak(F.col("_open"))},
    )
    place = F.col("_n") - F.col("_start")
    df = df.withColumn("dart_no", (place % DARTS + 1).cast("int"))
    df = running(
        df, keys, ORDER, {"_turns": total(F.when(F.col("dart_no") == 1, 1).otherwise(0))}
    )
    return df.withColumn("turn_no", (F.col("_turns") - 1).cast("bigint")).drop(
        "_n", "_before", "_open", "_start", "_turns"
    )


def assign_turns(throws: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Turn and dart number per session and player.

    Here and below, `counted` are the throws before corrections are resolved:
    sizes are read from them, so that the corrected ones are evaluated once.
    """
    keys = ["session_id", "player_id"]
    return over_groups(
        throws,
        ["session_id"],
        ORDER,
        lambda df, given: _with_turns(df, keys, given),
        noted=F.col("turn_id").isNotNull(),
        counted=counted,
    )


def turn_totals(throws: DataFrame) -> DataFrame:
    """Score and number of darts per turn. Expects `turn_no`."""
    return throws.groupBy("session_id", "player_id", "turn_no").agg(
        F.sum("score").alias("turn_score"), F.count(F.lit(1)).alias("darts")
    )


def running_score(throws: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Total so far per session and player."""
    keys, score = ["session_id", "player_id"], {"running_score": total(F.col("score"))}
    return over_groups(
        throws, ["session_id"], ORDER, lambda df: running(df, keys, ORDER, score), counted=counted
    )


def scoreboard(states: DataFrame, value: Sequence[str] = ("remaining", "status")) -> DataFrame:
    """The latest line per session and player."""
    last = F.max_by(F.struct(*ORDER, *value), F.struct(*ORDER))
    return (
        states.groupBy("session_id", "player_id")
        .agg(last.alias("last"), F.count(F.lit(1)).alias("n_throws"))
        .select("session_id", "player_id", "last.*", "n_throws")
    )


def close_groupings(throws: DataFrame, eps: float) -> DataFrame:
    """Pairs of darts of one turn closer than `eps`. Expects turn_no and dart_no.

    A turn has at most three darts, so the partners of a dart are the next one
    or two in its turn: a look ahead, not a self-join.
    """
    turn = ["session_id", "player_id", "turn_no"]
    ahead = Window.partitionBy(*turn).orderBy("dart_no")
    partner = F.struct("id", "dart_no", "x", "y")
    near = throws.select(
        *turn,
        "id",
        "dart_no",
        "x",
        "y",
        F.array(F.lead(partner, 1).over(ahead), F.lead(partner, 2).over(ahead)).alias("_next"),
    ).withColumn("_other", F.explode(F.array_compact("_next")))
    distance = F.sqrt(
        F.pow(F.col("x") - F.col("_other.x"), 2) + F.pow(F.col("y") - F.col("_other.y"), 2)
    )
    return (
        near.withColumn("distance", distance)
        .filter(F.col("distance") < F.lit(float(eps)))
        .select(
            *turn,
            "id",
            F.col("_other.id").alias("other_id"),
            "dart_no",
            F.col("_other.dart_no").alias("other_dart_no"),
            "distance",
        )
    )


# --- games ------------------------------------------------------------------


GAME = ["game_type", "start_score", "double_out", "started_at"]


def asof_game(throws: DataFrame, games: DataFrame, check_hot: bool = True) -> DataFrame:
    """Each throw with the game in force; null columns before the first."""
    stamped = games.withColumn("_from", F.col("started_at"))
    return as_of(
        throws,
        stamped,
        ["session_id"],
        "captured_at",
        "_from",
        "id",
        ["started_at", "game_type", "start_score", "double_out"],
        check_hot=check_hot,
    )


class _Sizes(NamedTuple):
    hot: bool
    long_legs: bool
    given_turns: bool


def _sizes(throws: DataFrame) -> _Sizes:
    """Whether a session is over-large, a leg can exceed one piece, turn ids are given."""
    per_player = throws.groupBy("session_id", "player_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("turn_id").alias("given")
    )
    top = (
        per_player.groupBy("session_id")
        .agg(
            F.sum("n").alias("session"), F.max("n").alias("player"), F.max("given").alias("given")
        )
        .agg(F.max("session").alias("session"), F.max("player").alias("player"), F.max("given").alias("given"))
        .first()
    )
    given = (top["given"] or 0) > 0
    # Without turn ids a turn has three darts, else it may have one.
    most = TURNS_PER_PIECE if given else TURNS_PER_PIECE * DARTS
    return _Sizes(
        (top["session"] or 0) > hot_limit(throws), (top["player"] or 0) > most, given
    )


def _over_legs(
    throws: DataFrame,
    games: DataFrame,
    game_type: str,
    columns: Sequence[str],
    hot: bool,
    body: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Apply `body` to the throws of one game type, with their leg.

    Splitting reads its input several times, so with an over-large session that
    input is written first, with no more than the rules need.
    """
    narrow = throws.select("id", "session_id", "player_id", "captured_at", *columns)
    if hot:
        narrow = cut_lineage(narrow)
    played = asof_game(narrow, games, check_hot=hot).filter(F.col("game_type") == game_type)
    return over_groups(cut_lineage(played), LEG, ORDER, body) if hot else body(played)


# --- X01 --------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is worked out once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _step(state: Column, dart: Column, double_out: Column) -> Column:
    """One dart in X01: what it leaves and how it counts."""
    same_turn = dart["turn_no"] == state["turn_no"]
    before = F.struct(
        F.when(same_turn, state["base"]).otherwise(state["remaining"]).alias("base"),
        (same_turn & state["void"]).alias("void"),
        (state["remaining"] - dart["score"]).alias("left"),
    )

    def status(b: Column) -> Column:
        left = b["left"]
        return (
            F.when(state["remaining"] == 0, "after")
            .when(b["void"], "void")
            .when((left == 0) & (~double_out | dart["double"]), "finish")
            .when((left <= 0) | ((left == 1) & double_out), "bust")
            .otherwise("scored")
        )

    def after(b: Column) -> Column:
        s = b["status"]
        remaining = (
            F.when(s == "scored", b["left"])
            .when(s == "finish", F.lit(0))
            .when(s == "bust", b["base"])
            .otherwise(state["remaining"])
        )
        return F.struct(
            dart["turn_no"].alias("turn_no"),
            remaining.alias("remaining"),
            b["base"].alias("base"),
            (b["void"] | (s == "bust")).alias("void"),
            s.alias("status"),
        )

    judged = _let(
        before,
        lambda b: F.struct(
            b["base"].alias("base"), b["void"].alias("void"), b["left"].alias("left"),
            status(b).alias("status"),
        ),
    )
    return _let(judged, after)


def _initial(remaining: Column) -> Column:
    return F.struct(
        F.lit(-1).cast("bigint").alias("turn_no"),
        remaining.cast("int").alias("remaining"),
        remaining.cast("int").alias("base"),
        F.lit(False).alias("void"),
        F.lit("").alias("status"),
    )


def _remaining_after(darts: Column, start: Column, double_out: Column) -> Column:
    folded = F.aggregate(darts, _initial(start), lambda s, d: _step(s, d, double_out))
    return folded["remaining"]


def _states(darts: Column, start: Column, double_out: Column) -> Column:
    """The fold of one piece, with the state after each dart."""

    def merge(acc: Column, dart: Column) -> Column:
        def line(after: Column) -> Column:
            shown = F.struct(after["remaining"].alias("remaining"), after["status"].alias("status"))
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(shown)).alias("out"))

        return _let(_step(acc["state"], dart, double_out), line)

    nothing = F.array().cast("array<struct<remaining:int,status:string>>")
    zero = F.struct(_initial(start).alias("state"), nothing.alias("out"))
    return F.zip_with(
        darts,
        F.aggregate(darts, zero, merge)["out"],
        lambda dart, o: F.struct(
            dart.alias("dart"), o["remaining"].alias("remaining"), o["status"].alias("status")
        ),
    )


def x01_states(
    throws: DataFrame, games: DataFrame, counted: DataFrame | None = None
) -> DataFrame:
    """X01 after each throw: remaining, and how the throw counted.

    `status` is scored, bust, void (rest of a bust turn), finish, or after (the
    leg is over, for whichever player finished it; `remaining` is then null).
    `counted` may name a table that has at least these throws and is cheaper to
    count, such as the stored events where `throws` is a result.
    """
    sizes = _sizes(throws if counted is None else counted)

    def play(legs: DataFrame) -> DataFrame:
        return _x01(legs, sizes)

    columns = ["turn_id", "multiplier", "score"]
    return _over_legs(throws, games, "X01", columns, sizes.hot, play)


def _x01(legs: DataFrame, sizes: _Sizes) -> DataFrame:
    player = [*LEG, "player_id"]
    pieces = (
        _with_turns(legs, player, sizes.given_turns)
        .select(
            *player,
            "start_score",
            "double_out",
            F.floor(F.col("turn_no") / TURNS_PER_PIECE).cast("bigint").alias("piece"),
            F.struct(
                "captured_at",
                "id",
                "turn_no",
                "dart_no",
                F.col("score").cast("int").alias("score"),
                F.coalesce(F.col("multiplier") == 2, F.lit(False)).alias("double"),
            ).alias("dart"),
        )
        .groupBy(*player, "piece")
        .agg(
            F.first("start_score").alias("start_score"),
            F.first("double_out").alias("double_out"),
            F.array_sort(F.collect_list("dart")).alias("darts"),
        )
    )
    if sizes.long_legs:
        pieces = _with_piece_starts(cut_lineage(pieces), player)
    else:
        pieces = pieces.withColumn("start", F.col("start_score"))
    folded = pieces.select(
        *player,
        _states(F.col("darts"), F.col("start"), F.col("double_out")).alias("out"),
    )
    finish = F.filter("out", lambda o: o["status"] == "finish")
    folded = folded.withColumn(
        "finished",
        F.when(
            F.size(finish) > 0,
            F.struct(finish[0]["dart"]["captured_at"].alias("at"), finish[0]["dart"]["id"].alias("id")),
        ),
    )
    if is_split(legs):
        folded = cut_lineage(folded)
        ended = folded.join(folded.groupBy(*LEG).agg(F.min("finished").alias("ended")), LEG)
    else:
        ended = folded.withColumn("ended", F.min("finished").over(Window.partitionBy(*LEG)))
    line = ended.select(*player, "ended", F.explode("out").alias("o"))
    position = F.struct(F.col("o.dart.captured_at").alias("at"), F.col("o.dart.id").alias("id"))
    after = F.coalesce(position > F.col("ended"), F.lit(False))
    return line.select(
        F.col("o.dart.id").alias("id"),
        *player,
        F.col("o.dart.captured_at").alias("captured_at"),
        F.col("o.dart.turn_no").alias("turn_no"),
        F.col("o.dart.dart_no").alias("dart_no"),
        F.when(~after, F.col("o.remaining")).alias("remaining"),
        F.when(after, "after").otherwise(F.col("o.status")).alias("status"),
    )


def _with_piece_starts(pieces: DataFrame, player: Sequence[str]) -> DataFrame:
    """Add what remains at the start of each piece of a leg.

    The effect of a piece is a table: what is left after it, for each value that
    can be left before it. Such tables chain, so a leg of any length is worked
    off in steps of bounded size. What the first piece leaves bounds the table.
    """
    # A leg of more than one piece has a second one; only those legs are chained.
    long = pieces.filter(F.col("piece") == 1).select(*[F.col(c).alias(f"_f_{c}") for c in player])
    same = [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in player]
    first = pieces.filter(F.col("piece") == 0).join(long, same, "left_semi").select(
        *[F.col(c).alias(f"_f_{c}") for c in player],
        _remaining_after(F.col("darts"), F.col("start_score"), F.col("double_out")).alias("head"),
    )
    later = pieces.filter(F.col("piece") > 0).join(first, same).drop(*[f"_f_{c}" for c in player])
    effects = cut_lineage(
        later.select(
            *player,
            "piece",
            "head",
            F.transform(
                F.sequence(F.lit(0), F.col("head")),
                lambda r: _remaining_after(F.col("darts"), r, F.col("double_out")),
            ).alias("effect"),
        )
    )
    longest = effects.agg(F.max("piece").alias("n")).first()["n"] or 0
    starts = _chain(effects, player, longest).select(
        *[F.col(c).alias(f"_s_{c}") for c in player], F.col("piece").alias("_s_piece"), "start"
    )
    match = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in player]
    return (
        pieces.join(starts, [*match, F.col("piece") == F.col("_s_piece")], "left")
        .withColumn("start", F.coalesce("start", "start_score"))
        .drop(*[f"_s_{c}" for c in player], "_s_piece")
    )


def _chain(effects: DataFrame, player: Sequence[str], longest: int) -> DataFrame:
    """(player, piece, start) from (player, piece, head, effect).

    `head` is what is left before the first piece of the table at hand.
    """
    grouped = effects.withColumn("block", F.floor(F.col("piece") / PIECES_PER_STEP)).groupBy(
        *player, "block"
    ).agg(
        F.first("head").alias("head"),
        F.array_sort(F.collect_list(F.struct("piece", "effect"))).alias("steps"),
    )
    if longest < PIECES_PER_STEP:
        blocks = grouped.withColumn("before", F.col("head"))
    else:
        whole = F.aggregate(
            "steps",
            F.sequence(F.lit(0), F.col("head")),
            lambda acc, s: F.transform(acc, lambda r: F.element_at(s["effect"], r + 1)),
        )
        grouped = cut_lineage(grouped)
        above = _chain(
            grouped.select(*player, F.col("block").alias("piece"), "head", whole.alias("effect")),
            player,
            longest // PIECES_PER_STEP,
        ).select(
            *[F.col(c).alias(f"_b_{c}") for c in player],
            F.col("piece").alias("_b_block"),
            F.col("start").alias("before"),
        )
        match = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in player]
        blocks = grouped.join(above, [*match, F.col("block") == F.col("_b_block")])
    path = F.aggregate(
        "steps",
        F.struct(F.col("before").alias("now"), F.array().cast("array<int>").alias("starts")),
        lambda acc, s: F.struct(
            F.element_at(s["effect"], acc["now"] + 1).alias("now"),
            F.concat(acc["starts"], F.array(acc["now"])).alias("starts"),
        ),
    )["starts"]
    return blocks.select(
        *player, F.explode(F.arrays_zip(F.col("steps")["piece"].alias("piece"), path.alias("start"))).alias("s")
    ).select(*player, F.col("s.piece").alias("piece"), F.col("s.start").alias("start"))


def fold_game(
    throws: DataFrame,
    keys: Sequence[str],
    init: Callable[[], Column],
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column] | None = None,
    columns: Sequence[str] = ("segment", "multiplier", "score"),
) -> DataFrame:
    """Fold the throws of each group in order with the rules of another game.

    `init`, `step` and `finish` are column expressions over a state of one type.
    At most `THROWS_PER_FOLD` throws are put into one row. A longer group is
    folded one such piece after the other, each from the state the last one
    left; other groups are not held up by it, as each round only has the groups
    that go on.
    """
    finish = finish or (lambda state: state)
    dart = F.struct(*ORDER, *columns)

    def number(df: DataFrame) -> DataFrame:
        return running(df, keys, ORDER, {"_n": total(F.lit(1))})

    def fold(groups: DataFrame, start: Column) -> DataFrame:
        darts = F.array_sort(F.collect_list("_dart"))
        rows = groups.groupBy(*keys).agg(darts.alias("_darts"), F.first("_start").alias("_start"))
        return rows.select(*keys, F.aggregate("_darts", start, step).alias("_state"))

    rows = over_groups(throws.select(*keys, *{*ORDER, *columns} - {*keys}), keys, ORDER, number)
    rows = rows.select(
        *keys,
        F.floor((F.col("_n") - 1) / THROWS_PER_FOLD).alias("_piece"),
        dart.alias("_dart"),
    )
    sizes = throws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    last = ((sizes.first()["n"] or 0) - 1) // THROWS_PER_FOLD
    if last > 0:
        rows = cut_lineage(rows)
    first = rows.filter(F.col("_piece") == 0) if last > 0 else rows
    state = fold(first.withColumn("_start", F.lit(None)), init())
    done = None
    for piece in range(1, last + 1):
        state = cut_lineage(state)
        started = state.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_state").alias("_start")
        )
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        more = rows.filter(F.col("_piece") == piece).join(started, same)
        going = more.select(*keys).distinct().select(*[F.col(k).alias(f"_k_{k}") for k in keys])
        over = state.join(going, same, "left_anti")
        done = over if done is None else done.unionByName(over)
        state = fold(more, F.col("_start"))
    whole = state if done is None else done.unionByName(state)
    return whole.select(*keys, finish(F.col("_state")).alias("state"))


def fold_states(
    throws: DataFrame,
    keys: Sequence[str],
    states: int,
    start: int,
    step: Callable[[Column, Column], Column],
    columns: Sequence[str] = ("segment", "multiplier", "score"),
) -> DataFrame:
    """E3 in parallel, for rules that know but so many states: (keys…, state).

    A state is a number from 0 to `states` - 1 and `step` goes from one to
    another. Each piece of a group is folded from every state, all pieces at
    once; that makes a table from state to state, and tables of neighbours are
    put together, pairs of pairs. So a group of any length takes as many rounds
    as the logarithm of its pieces, and no task has more than a piece. `step`
    runs `states` times a throw, so this is for tens or hundreds of states;
    `fold_game` is for others.
    """
    dart = F.struct(*ORDER, *columns)

    def number(df: DataFrame) -> DataFrame:
        return running(df, keys, ORDER, {"_n": total(F.lit(1))})

    rows = over_groups(throws.select(*keys, *{*ORDER, *columns} - {*keys}), keys, ORDER, number)
    piece = F.floor((F.col("_n") - 1) / THROWS_PER_FOLD).alias("_piece")
    folded = (
        rows.select(*keys, piece, dart.alias("_dart"))
        .groupBy(*keys, "_piece")
        .agg(F.array_sort(F.collect_list("_dart")).alias("_darts"))
    )
    every = F.sequence(F.lit(0), F.lit(states - 1))
    tables = cut_lineage(
        folded.select(
            *keys,
            "_piece",
            F.transform(
                every, lambda s: F.aggregate("_darts", s, lambda state, d: step(state, d).cast("int"))
            ).alias("_table"),
        )
    )
    last = tables.agg(F.max("_piece")).first()[0] or 0
    while last > 0:
        even = F.col("_piece") % 2 == 0
        both = tables.groupBy(*keys, F.floor(F.col("_piece") / 2).alias("_pair")).agg(
            F.max(F.when(even, F.col("_table"))).alias("_a"), F.max(F.when(~even, F.col("_table"))).alias("_b")
        )
        after = F.transform("_a", lambda s: F.get("_b", s))
        tables = cut_lineage(
            both.select(*keys, F.col("_pair").alias("_piece"), F.when(F.col("_b").isNull(), F.col("_a")).otherwise(after).alias("_table"))
        )
        last //= 2
    return tables.select(*keys, F.get("_table", F.lit(start)).alias("state"))


# --- Cricket ----------------------------------------------------------------


def _count_players(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the number of players of the leg, also those who have yet to throw."""
    if is_split(df):
        players = (
            df.groupBy(*keys, "player_id")
            .agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_players"))
        )
        return df.join(players, list(keys))
    mine = Window.partitionBy(*keys, "player_id").orderBy(*ORDER)
    first = F.when(F.row_number().over(mine) == 1, 1).otherwise(0)
    return (
        df.withColumn("_first", first)
        .withColumn("n_players", F.sum("_first").over(Window.partitionBy(*keys)))
        .drop("_first")
    )


def _with_marks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add marks, and the marks of the player on the number before and after."""
    hits = F.col("segment").isin(*CRICKET_NUMBERS)
    df = df.withColumn("marks", F.when(hits, F.col("multiplier")).otherwise(0))
    df = running(df, [*keys, "player_id", "segment"], ORDER, {"marks_sum": total(F.col("marks"))})
    return df.withColumn("_marks_before", F.col("marks_sum") - F.col("marks"))


def _together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One shuffle on the leg for all windows to come."""
    return df if is_split(df) else df.repartition(*keys)


def cricket_marks(
    throws: DataFrame, keys: Sequence[str] = ("session_id",), counted: DataFrame | None = None
) -> DataFrame:
    """Marks so far per player and number, at most three; Cricket numbers only."""
    hits = throws.filter(F.col("segment").isin(*CRICKET_NUMBERS))
    marked = over_groups(hits, list(keys), ORDER, lambda df: _with_marks(df, keys), counted=counted)
    return marked.withColumn("marks_so_far", F.least(F.col("marks_sum"), F.lit(3))).drop(
        "marks_sum", "_marks_before"
    )


def _cricket(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = _with_marks(_count_players(_together(df, keys), keys), keys)
    before, now = F.col("_marks_before"), F.col("marks_sum")
    zero = F.lit(0)
    df = df.withColumn("closes", F.when((now >= 3) & (before < 3), 1).otherwise(0))
    df = running(df, [*keys, "segment"], ORDER, {"_closed": total(F.col("closes"))})
    others_closed = F.col("_closed") - F.when(now >= 3, 1).otherwise(0)
    surplus = F.greatest(now - 3, zero) - F.greatest(before - 3, zero)
    df = df.withColumn(
        "points",
        F.when(others_closed < F.col("n_players") - 1, surplus * F.col("segment")).otherwise(zero),
    )
    df = running(
        df,
        [*keys, "player_id"],
        ORDER,
        {"points_so_far": total(F.col("points")), "numbers_closed": total(F.col("closes"))},
    )
    # Points never fall, so the most any player has is the most any row has shown.
    df = running(df, keys, ORDER, {"_top": peak(F.col("points_so_far"))})
    done = (F.col("numbers_closed") == len(CRICKET_NUMBERS)) & (
        F.col("points_so_far") >= F.col("_top")
    )
    df = df.withColumn("wins", F.when(done, 1).otherwise(0))
    df = running(df, keys, ORDER, {"_wins": total(F.col("wins"))})
    after = F.col("_wins") - F.col("wins") > 0
    return df.select(
        "id",
        *keys,
        "player_id",
        "captured_at",
        "segment",
        "marks",
        (F.col("closes") == 1).alias("closes"),
        "points",
        "points_so_far",
        "numbers_closed",
        (F.col("wins") == 1).alias("wins"),
        after.alias("after"),
    )


def cricket_points(
    throws: DataFrame, keys: Sequence[str] = ("session_id",), counted: DataFrame | None = None
) -> DataFrame:
    """Points per throw and so far, and which throws close a number.

    A throw marked `after` came when the leg was won; it does not count.
    """
    return over_groups(throws, list(keys), ORDER, lambda df: _cricket(df, keys), counted=counted)


def cricket_states(
    throws: DataFrame, games: DataFrame, counted: DataFrame | None = None
) -> DataFrame:
    """W6 over the Cricket legs of the games in force; `counted` as for X01."""
    hot = _sizes(throws if counted is None else counted).hot
    columns = ["segment", "multiplier"]
    return _over_legs(throws, games, "Cricket", columns, hot, lambda df: _cricket(df, LEG))


def cricket_standings(
    throws: DataFrame, games: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Points, closed numbers and winner per leg.

    With `games` the Cricket legs are found by time, without it each session is
    one leg.
    """
    if games is None:
        keys, points = ["session_id"], cricket_points(throws, counted=counted)
    else:
        keys, points = LEG, cricket_states(throws, games, counted)
    counts = ~F.col("after")
    return points.groupBy(*keys, "player_id").agg(
        F.sum(F.when(counts, F.col("points")).otherwise(0)).alias("points"),
        F.count_if(counts & F.col("closes")).alias("numbers_closed"),
        F.count_if(counts).alias("darts"),
        F.bool_or(counts & F.col("wins")).alias("winner"),
    )


# Ranges of the hash of a row by which two runs are told apart.
RANGES = 1024


def run_digest(run: DataFrame) -> DataFrame:
    """Of each range of a run: how many rows, and two sums of their hashes. At most RANGES rows.

    May be stored with a run. Runs with equal digests have equal rows, but for
    chances of 2^-128; order and number of partitions do not matter.
    """
    columns = sorted(run.columns)
    first = F.xxhash64(*columns)
    sums = [F.sum(h.cast("decimal(20,0)")) for h in (first, F.xxhash64(F.lit(1), *columns))]
    return run.groupBy(F.pmod(first, F.lit(RANGES)).cast("int").alias("range")).agg(
        F.count(F.lit(1)).alias("n"), sums[0].alias("sum1"), sums[1].alias("sum2")
    )


def replay_diff(
    a: DataFrame, b: DataFrame, a_digest: DataFrame | None = None, b_digest: DataFrame | None = None
) -> DataFrame:
    """Rows on which two runs differ, with the run that has them.

    First the digests of both are compared, stored ones or computed here. Only
    rows in ranges that differ are compared themselves; equal runs cost a sum
    each and no comparison of rows.
    """
    a_digest = run_digest(a) if a_digest is None else a_digest
    b_digest = run_digest(b) if b_digest is None else b_digest
    key = F.struct("n", "sum1", "sum2")
    sides = a_digest.select("range", key.alias("a")).join(
        b_digest.select(F.col("range").alias("_range"), key.alias("b")), F.col("range") == F.col("_range"), "full"
    )
    differ = [r[0] for r in sides.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("range", "_range")).collect()]
    if not differ:
        return a.limit(0).withColumn("only_in", F.lit("a"))
    inside = F.pmod(F.xxhash64(*sorted(a.columns)), F.lit(RANGES)).isin(differ)
    a, b = a.filter(inside), b.select(*a.columns).filter(inside)
    return (
        a.exceptAll(b)
        .withColumn("only_in", F.lit("a"))
        .unionByName(b.exceptAll(a).withColumn("only_in", F.lit("b")))
    )
