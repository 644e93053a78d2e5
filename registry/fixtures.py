"""The tables of FIXTURES.md, derived row by row from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocheline.operators.board import map_segment, to_notation, with_score
from ocheline.plans.storage import cut_lineage, session_folder

BOARD_POINTS = {"n": (0.0, 1.0), "e": (1.0, 0.0), "s": (0.0, -1.0), "w": (-1.0, 0.0)}


# The given tables that are read, with their declared columns.
SCHEMAS = {
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# The events arrive in so many deliveries, each up to so many seconds late.
DELIVERIES = 4
DELAY = 7200
# Events in a file of a delivery, about.
FILE_ROWS = 50_000
# The keys of the event that ends a stream.
END_SESSION, END_ID, END_RUNTIME = "s-1", "-1", "end"


def event_stream(spark: SparkSession, sf_dir: str, marked: bool = True) -> DataFrame:
    """All events as a stream of files, in event time, out of order, and with an end.

    Without `marked` the stream has no watermark.

    An event arrives up to DELAY seconds after it happened; what arrives in a
    span of time is one delivery, and a batch reads one, in any number of files.
    Within a delivery events come in any order, so the lateness is the span and
    the delay. The last delivery is one event long
    after the others, of a session of its own, with which all others close.
    In a stream an error corrects an event of its own session (`corrects`).
    """
    folder = f"{session_folder(spark)}/events-{uuid.uuid4().hex}"
    ordered = Window.partitionBy("pair").orderBy("ts", "event_id")
    earlier = F.coalesce(*[F.when(F.col("k") % 3 == n, F.lag("event_id", 1 + n).over(ordered)) for n in range(3)])
    lost = F.concat(F.lit("lost-"), F.col("event_id").cast("string"))
    corrects = F.when(
        F.col("event_type") == "error",
        F.when(F.col("k") >= 95, lost).otherwise(F.coalesce(earlier.cast("string"), lost)),
    )
    columns = [*table(spark, sf_dir, "events").columns, "corrects"]
    events = _events(spark, sf_dir).withColumn("corrects", corrects).select(*columns)
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    low, high, rows = events.agg(F.min(seconds), F.max(seconds), F.count(F.lit(1))).first()
    span = -(-(high - low + DELAY + 1) // DELIVERIES)
    delivery = F.floor((seconds + F.pmod(F.xxhash64("event_id"), F.lit(DELAY)) - low) / span)
    parts = -(-rows // (DELIVERIES * FILE_ROWS))
    dealt = cut_lineage(events.withColumn("delivery", delivery))
    written = 0
    for number in range(DELIVERIES):
        mine = dealt.where(F.col("delivery") == number).select(*columns)
        mine.repartition(parts).write.mode("append").parquet(folder)
        # All deliveries have the same number of files, so that a batch reads one of them.
        written += parts
        for _ in range(written - len(spark.read.schema(mine.schema).parquet(folder).inputFiles())):
            mine.limit(0).coalesce(1).write.mode("append").parquet(folder)
    end = events.limit(1).select(
        F.lit(-1).cast("bigint").alias("event_id"),
        F.timestamp_add("DAY", F.lit(400), F.timestamp_seconds(F.lit(high)).cast("timestamp_ntz")).alias("ts"),
        F.lit(-2).cast("bigint").alias("user_id"),
        F.lit(END_RUNTIME).alias("event_type"),
        F.lit(0.0).alias("value"),
        F.lit('{"k": 50}').alias("props"),
        F.lit(None).cast("string").alias("corrects"),
    )
    end.write.mode("append").parquet(folder)
    files = (
        spark.readStream.schema(SCHEMAS["events"] + ", corrects string")
        .option("maxFilesPerTrigger", parts)
        .parquet(folder)
    )
    timed = files.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", f"{span + DELAY} seconds") if marked else timed


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_keys(table(spark, sf_dir, "events"))


def with_keys(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "*",
        "cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k",
        "user_id div 2 AS pair",
        "concat('s', user_id div 2) AS session_id",
        "concat('p', user_id) AS player_id",
        "concat('c', user_id) AS calibration_id",
        "((event_id * 7919) % 2001 - 1000) * 0.0011D AS x",
        "((event_id * 104729) % 2003 - 1001) * 0.0011D AS y",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board points before they are mapped."""
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("frame_no"),
        "session_id",
        "player_id",
        F.col("ts").alias("captured_at"),
        "x",
        "y",
        (F.col("k") / F.lit(100.0)).alias("confidence"),
        "calibration_id",
    )


def throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors correct one of the three events before them, or one that is lost."""
    return throws_of(_events(spark, sf_dir))


def throws_of(events: DataFrame) -> DataFrame:
    corrects = """CASE WHEN event_type <> 'error' THEN NULL WHEN k >= 95 THEN concat('lost-', event_id)
           ELSE cast(event_id - 1 - k % 3 AS string) END"""
    if "corrects" in events.columns:
        corrects = "corrects"
    base = events.selectExpr(
        "cast(event_id AS string) AS id",
        "session_id",
        "player_id",
        "cast(NULL AS string) AS turn_id",
        "ts AS captured_at",
        "x",
        "y",
        "k / 100D AS confidence",
        "calibration_id",
        "if(event_type = 'error', 'manual-correction', 'camera') AS source",
        f"{corrects} AS correction_of",
    )
    scored = to_notation(with_score(map_segment(base)))
    return scored.select(
        "id",
        "session_id",
        "player_id",
        "turn_id",
        "captured_at",
        "x",
        "y",
        "segment",
        "multiplier",
        "score",
        "notation",
        "confidence",
        "calibration_id",
        "source",
        "correction_of",
    )


def throws_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throws with planted faults; some rows come twice."""
    return dirty_of(throws(spark, sf_dir))


def throws_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throws that break each of the twelve rules now and then, some several at once."""
    t, n = throws(spark, sf_dir), F.col("id").cast("bigint")

    def now_and_then(step: int, value, column: str):
        return F.when(n % step == 0, value).otherwise(F.col(column)).alias(column)

    manual = F.when(F.col("correction_of").isNull(), "1")
    changed = {
        "session_id": (127, F.lit(None)),
        "captured_at": (131, F.lit(None)),
        "x": (137, F.lit(float("nan"))),
        "segment": (139, F.lit(21)),
        "multiplier": (149, F.lit(4)),
        "score": (97, F.col("score") + 1),
        "notation": (151, F.lit("?")),
        "confidence": (101, F.col("confidence") + 1),
        "calibration_id": (157, F.lit(None)),
        "source": (103, F.lit("other")),
        "correction_of": (163, manual),
        "id": (113, F.lit(None)),
    }
    return t.select(
        n.alias("event_id"),
        *[now_and_then(*changed[c], c) if c in changed else F.col(c) for c in t.columns],
    )


def dirty_of(clean: DataFrame) -> DataFrame:
    n = F.col("id").cast("bigint")
    copies = F.when(n % 50 == 0, 2).otherwise(1)
    return (
        clean.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .drop("_copy")
        .withColumns(
            {
                "score": F.when(n % 97 == 0, F.col("score") + 1).otherwise(F.col("score")),
                "confidence": F.when(n % 101 == 0, F.col("confidence") + 1).otherwise(
                    F.col("confidence")
                ),
                "source": F.when(n % 103 == 0, "other").otherwise(F.col("source")),
            }
        )
    )


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text, some with fields of a vendor, at the top or in the impact."""
    field = F.concat(F.lit(',"'), F.col("event_type"), F.lit('":'), F.col("props"))
    extra = F.when(F.col("event_type").isin("purchase", "signup"), field).otherwise("")
    inner = F.when(F.col("event_type") == "click", field).otherwise("")
    return _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(
            F.lit('{"id":"'),
            F.col("event_id").cast("string"),
            F.lit('","sessionId":"'),
            F.col("session_id"),
            F.lit('","source":"camera","impact":{"xNormalized":0.5'),
            inner,
            F.lit("}"),
            extra,
            F.lit("}"),
        ).alias("raw"),
    )


def frame_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landmarks found in each frame; every seventh frame lacks one."""
    n = F.col("event_id")
    names = F.when(n % 7 == 0, F.array(*map(F.lit, "nes"))).otherwise(F.array(*map(F.lit, "nesw")))
    return _events(spark, sf_dir).select("session_id", n.alias("frame_no"), F.explode(names).alias("name"))


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four landmarks per supplier; geometry 8 lacks one, geometry 9 is a line."""
    i = F.col("s_suppkey") % 10

    def point(name: str):
        bx, by = BOARD_POINTS[name]
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(bx).alias("bx"),
            F.when(i == 9, F.lit(0.0)).otherwise(F.lit(by)).alias("by0"),
        )

    all_names = F.array(*[point(n) for n in "nesw"])
    three = F.array(*[point(n) for n in "nes"])
    spots = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("calibration_id"),
        i.cast("double").alias("i"),
        F.explode(F.when(i == 8, three).otherwise(all_names)).alias("p"),
    )
    px, py = _pixel(F.col("p.bx"), F.col("p.by0"), F.col("i"))
    return spots.select(
        "calibration_id",
        F.col("p.name").alias("name"),
        px.alias("px"),
        py.alias("py"),
        F.col("p.bx").alias("bx"),
        F.col("p.by0").alias("by0"),
    )


def _pixel(bx, by, i):
    depth = F.lit(1.0) + F.lit(0.01) * i * bx + F.lit(0.02) * by
    px = (F.lit(300.0) * bx + F.lit(5.0) * i * by + F.lit(640.0)) / depth
    py = (F.lit(-300.0) * by + F.lit(3.0) * i * bx + F.lit(360.0)) / depth
    return px, py


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image-to-board mapping of each supplier's geometry, in closed form."""
    key = F.col("s_suppkey")
    i = (key % 10).cast("double")
    a, b, c = F.lit(300.0), F.lit(5.0) * i, F.lit(640.0)
    d, e, f = F.lit(3.0) * i, F.lit(-300.0), F.lit(360.0)
    g, h = F.lit(0.01) * i, F.lit(0.02)
    last = a * e - b * d
    inverse = [
        e - f * h, c * h - b, b * f - c * e,
        f * g - d, a - c * g, c * d - a * f,
        d * h - e * g, b * g - a * h, last,
    ]
    day = (key * 37 % 29).cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    valid = key % 10 < 8
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), key.cast("string")).alias("calibration_id"),
        F.concat(F.lit("s"), F.floor(key / 2).cast("string")).alias("session_id"),
        F.when(valid, start + F.make_dt_interval(days=day)).alias("validated_at"),
        F.array(*[v / last for v in inverse]).alias("h"),
        F.when(valid, 8).alias("rank"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every throw seen from three views."""
    return detections_of(_events(spark, sf_dir))


def detections_of(events: DataFrame) -> DataFrame:
    seen = events.withColumn(
        "view", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    )
    bx = F.col("x") + (F.col("view") - 1) * F.lit(0.002)
    px, py = _pixel(bx, F.col("y"), (F.col("user_id") % 10).cast("double"))
    return seen.select(
        F.col("event_id").cast("string").alias("throw_id"),
        "session_id",
        "player_id",
        "view",
        (F.col("event_id") * 3 + F.col("view")).alias("frame_no"),
        F.col("ts").alias("captured_at"),
        px.alias("px"),
        py.alias("py"),
        (((F.col("k") + 31 * F.col("view")) % 100 + 1) / F.lit(101.0)).alias("confidence"),
        "calibration_id",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(_events(spark, sf_dir))


def frames_of(events: DataFrame) -> DataFrame:
    return events.select(
        "session_id",
        F.col("event_id").alias("frame_no"),
        F.col("ts").alias("captured_at"),
        (F.col("event_id") % 4).alias("n_tips"),
        F.col("event_type").alias("runtime"),
        F.col("value").alias("latency_ms"),
    )


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections keyed by the frame of `frames` they were found in."""
    return detections(spark, sf_dir).withColumn("frame_no", F.col("throw_id").cast("bigint"))


def long_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All originals in two sessions of two players, so that legs have hundreds of turns."""
    number = F.substring("player_id", 2, 20).cast("bigint")
    return (
        throws(spark, sf_dir)
        .filter(F.col("correction_of").isNull())
        .withColumns(
            {
                "session_id": F.concat(F.lit("L"), (F.floor(number / 2) % 2).cast("string")),
                "player_id": F.concat(F.lit("q"), (number % 2).cast("string")),
            }
        )
    )


def long_games(spark: SparkSession) -> DataFrame:
    """One leg of either session; 1,001 is not finished soon."""
    rows = [("L0", "X01", 1001, True), ("L1", "X01", 501, False)]
    legs = spark.createDataFrame(
        rows, "session_id string, game_type string, start_score int, double_out boolean"
    )
    return legs.withColumn("started_at", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs per session: from its first throw, and from the 16th."""
    n = F.col("pair")
    second = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return (
        _events(spark, sf_dir)
        .groupBy("session_id", "pair")
        .agg(F.min("ts").alias("first"))
        .select(
            "session_id",
            F.when(n % 2 == 0, "X01").otherwise("Cricket").alias("game_type"),
            F.when(n % 3 == 0, 301).when(n % 3 == 1, 501).otherwise(701).alias("start_score"),
            (n % 5 != 0).alias("double_out"),
            F.explode(F.array(F.col("first"), second)).alias("started_at"),
        )
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of most sessions; nothing is known of every seventh."""
    n = F.col("pair")
    return (
        _events(spark, sf_dir)
        .select("session_id", "pair")
        .distinct()
        .filter(n % 7 != 6)
        .select(
            "session_id",
            F.concat(F.lit("l"), (n % 3).cast("string")).alias("lighting"),
            F.concat(F.lit("b"), (n % 2).cast("string")).alias("board"),
            F.concat(F.lit("d"), (n % 5).cast("string")).alias("dart"),
        )
    )


def calibration_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == "signup")
        .select("session_id", "ts", (F.col("k") >= 50).alias("valid"))
    )


def adapter_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granted from the first signup to the last purchase of a session."""
    opened = F.min(F.when(F.col("event_type") == "signup", F.col("ts")))
    ended = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return (
        _events(spark, sf_dir)
        .groupBy("session_id")
        .agg(opened.alias("valid_from"), ended.alias("valid_to"))
        .select(F.lit("scores").alias("adapter"), "session_id", "valid_from", "valid_to")
    )


def adapter_mapping(spark: SparkSession) -> DataFrame:
    rows = [
        ("scores", "notation", "field"),
        ("scores", "score", "points"),
        ("scores", "player_id", "thrower"),
        ("scores", "session_id", "match"),
    ]
    return spark.createDataFrame(rows, "adapter string, canonical string, vendor string")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("dataset"),
        F.when(F.col("p_type") == "PROMO", "unknown").otherwise(F.col("p_brand")).alias("licence"),
    )


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int")
    return (
        table(spark, sf_dir, "part")
        .select(F.col("p_brand").alias("licence"), (number % 2 == 0).alias("commercial"))
        .distinct()
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), F.floor(key / 100).cast("string")).alias("repo"),
        (key % 100 + 1).alias("number"),
        "p_partkey",
        "p_name",
        "p_type",
        "p_size",
        F.concat(F.lit("Decided: "), F.col("p_name")).alias("resolution"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per hundred parts; its first part is the map."""
    parts = _parts(spark, sf_dir)
    n, size = F.col("number"), F.col("p_size")
    is_map = n == 1
    kind = (
        F.when(F.col("p_type") == "ECONOMY", "[Wayfinder Research] ")
        .when(F.col("p_type") == "SMALL", "[Wayfinder Prototype] ")
        .when(F.col("p_type") == "PROMO", "[Wayfinder Grilling] ")
        .when(F.col("p_type") == "STANDARD", "[Wayfinder Task] ")
        .otherwise("")
    )
    blocked = F.when(F.col("p_partkey") % 4 == 0, "none").otherwise(
        F.concat(
            F.lit("#"), F.floor(n / 2).cast("string"), F.lit(", #"), F.floor(n / 3).cast("string")
        )
    )
    question = (
        F.when(size % 7 == 0, "## Question\n\nA\n\n## Question\n\n")
        .when(size % 11 == 0, "")
        .otherwise("## Question\n\n")
    )
    ticket_body = F.concat(
        F.lit("Parent map: #1\nType: wayfinder:task\nBlocked by: "),
        blocked,
        F.lit("\n\n"),
        question,
        F.col("p_name"),
    )
    entry = F.concat(
        F.lit("- #"),
        n.cast("string"),
        F.lit(": "),
        F.when(size % 4 == 0, F.col("resolution")).otherwise("see ticket"),
        F.lit("\n"),
    )
    # A map lists at most the hundred tickets of its repository.
    listed = (
        parts.filter((n != 1) & (size % 6 == 0))
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(F.struct("number", entry.alias("entry")))).alias("e"))
        .select("repo", F.array_join(F.transform("e", lambda e: e["entry"]), "").alias("entries"))
    )
    map_body = F.concat(
        F.lit("## Destination\n\n"),
        F.col("p_name"),
        F.lit("\n\n## Notes\n\n## Decisions so far\n\n"),
        F.coalesce("entries", F.lit("")),
        F.lit("\n## Not yet specified\n"),
        F.when(size % 2 == 0, "").otherwise("\n## Out of scope\n"),
    )
    return parts.join(listed, "repo", "left").select(
        "repo",
        "number",
        F.when(is_map, F.concat(F.lit("[Wayfinder Map] "), "p_name"))
        .otherwise(F.concat(kind, "p_name"))
        .alias("title"),
        F.when(size % 3 == 0, "closed").otherwise("open").alias("state"),
        F.when(size % 5 == 0, F.concat(F.lit("dev"), size.cast("string"))).alias("assignee"),
        F.when(is_map, map_body).otherwise(ticket_body).alias("body"),
        F.when(~is_map & (size % 13 == 0), F.lit(2)).cast("bigint").alias("native_parent"),
        F.when(~is_map & (size % 17 == 0), F.array(F.lit(1).cast("bigint"))).alias(
            "native_blockers"
        ),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    resolves = (
        (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O")
    )
    return lines.join(_parts(spark, sf_dir), "p_partkey").select(
        "repo",
        "number",
        F.col("l_shipdate").alias("ts"),
        F.when(resolves, "resolution").otherwise("comment").alias("kind"),
        F.col("resolution").alias("text"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), F.floor(key / 100).cast("string")).alias("repo"),
        (key % 100 + 1).alias("number"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linenumber") == 1, "assigned").otherwise("commit").alias("kind"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    short = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    name = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("prototype/"), short))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("prototype/old/"), short))
        .otherwise(F.concat(F.lit("feature/"), short))
    )
    return parts.select("repo", "number", name.alias("name"))
