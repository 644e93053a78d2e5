"""Streams, sources and sinks over the whole events table.

Each query processes what there is, writes to the shared folder of the session
and returns what arrived there. Instants come back without a zone (UTC), like
those of the given tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ocheline.operators import events as ev
from ocheline.plans.storage import cut_lineage, session_folder
from ocheline.sources import frames, once, outbox, tables
from ocheline.streaming import held, live, sources
from registry import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
STREAMS: dict[str, Query] = {}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ZONE = "spark.sql.session.timeZone"
PARTITIONS = "spark.sql.shuffle.partitions"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
# State stores for each core. Each is opened and committed by a task of every batch.
STORES_A_CORE = 2


def _stores(spark: SparkSession) -> str:
    """The number of state partitions: by the cores there are, never more than the session's own."""
    cores = max(8, spark.sparkContext.defaultParallelism)
    return str(min(int(spark.conf.get(PARTITIONS)), STORES_A_CORE * cores))


def query(fn: Query) -> Query:
    def in_utc(spark: SparkSession, d: str) -> DataFrame:
        """The instants of the given tables are UTC; keyed state needs RocksDB."""
        during = {PROVIDER: ROCKSDB, ZONE: "UTC", PARTITIONS: _stores(spark), CHANGELOG: "true"}
        before = {key: spark.conf.get(key, None) for key in during}
        for key, value in during.items():
            spark.conf.set(key, value)
        try:
            return fn(spark, d)
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    STREAMS[fn.__name__] = in_utc
    return fn


def _folder(spark: SparkSession) -> str:
    return f"{session_folder(spark)}/stream-{uuid.uuid4().hex}"


def _finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _arrived(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _finish(
        stream.writeStream.foreachBatch(keep)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out")


def _plain(column: str) -> F.Column:
    return F.to_utc_timestamp(column, "UTC").cast("timestamp_ntz").alias(column)


def _throws(spark: SparkSession, d: str) -> DataFrame:
    return fx.throws_of(fx.with_keys(fx.event_stream(spark, d)))


def _utc_games(spark: SparkSession, d: str) -> DataFrame:
    return fx.games(spark, d).withColumn("started_at", F.col("started_at").cast("timestamp"))


def _written(spark: SparkSession, d: str) -> str:
    """A folder of lines: throws as JSON, some broken, some without a time."""
    folder = _folder(spark)
    t = fx.throws(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    n = F.col("id").cast("bigint")
    nested = ev.nest_throws(t).withColumn(
        "capturedAt", F.when(n % 223 == 0, "at noon").otherwise(F.col("capturedAt"))
    )
    line = F.to_json(F.struct(*nested.columns))
    nested.select(F.when(n % 211 == 0, F.concat(F.lit("broken "), "id")).otherwise(line)).write.text(folder)
    return folder


@query
def s1_read_throws(spark, d):
    """Throws written as lines of JSON and read back, good and bad ones."""
    good, bad = tables.read_throws(spark, _written(spark, d))
    return good.select("id", "session_id", _plain("captured_at"), "x", "score", "correction_of").unionByName(
        bad.select("id", "reason"), allowMissingColumns=True
    )


@query
def s2_stream_throws(spark, d):
    """Throws written as lines of JSON and read as a stream."""
    seen = _arrived(sources.stream_throws(spark, _written(spark, d)))
    return seen.select("id", _plain("captured_at"), "notation", "confidence", "source")


@query
def s2_stream_rejects(spark, d):
    """The lines of the stream that are no throw events."""
    seen = _arrived(sources.stream_rejects(spark, _written(spark, d)))
    return seen.select("id", "reason", F.substring("raw", 1, 6).alias("begins"))


@query
def s3_read_calibrations(spark, d):
    folder = _folder(spark)
    stored = fx.calibrations(spark, d).withColumn("validated_at", F.col("validated_at").cast("timestamp"))
    stored.write.parquet(folder)
    found = tables.read_calibrations(spark, folder)
    return found.select("calibration_id", _plain("validated_at"), F.round(F.col("h")[0], 9).alias("h0"))


@query
def s3_read_landmarks(spark, d):
    folder = _folder(spark)
    fx.landmarks(spark, d).write.parquet(folder)
    found = tables.read_landmarks(spark, folder)
    return found.select("calibration_id", "name", F.round("px", 6).alias("px"), "bx", "by0")


@query
def s4_read_frames(spark, d):
    """Images written by tasks as files named by session and frame, and read back."""
    folder = _folder(spark)
    seen = fx.frames(spark, d).select("session_id", "frame_no")
    letter = F.char(F.lit(65) + F.col("frame_no") % 26)
    image = F.repeat(letter, (F.lit(1) + F.col("frame_no") % 97).cast("int"))
    frames.write_frames(seen.withColumn("content", image.cast("binary")), folder)
    found = tables.read_frames(spark, folder, with_bytes=True)
    return found.select("session_id", "frame_no", "n_bytes", F.md5("content").alias("digest"))


@query
def s5_read_detections(spark, d):
    folder = _folder(spark)
    seen = fx.detections(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    seen.write.parquet(folder)
    found = tables.read_detections(spark, folder)
    return found.select("throw_id", "view", "frame_no", _plain("captured_at"), "confidence")


@query
def s9_read_issues(spark, d):
    folder = _folder(spark)
    fx.issues(spark, d).write.json(folder)
    return tables.read_issues(spark, folder).select("repo", "number", "state", "native_parent")


@query
def s6_store_throws(spark, d):
    folder = _folder(spark)
    t = fx.throws(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    tables.write_throws(t, folder)
    return tables.stored_throws(spark, folder).groupBy("capture_date").agg(
        F.count(F.lit(1)).alias("throws"), F.sum("score").alias("points")
    )


@query
def s7_publish(spark, d):
    """Overlapping deliveries to the outbox, the last one under another day."""
    folder = _folder(spark)
    t = fx.throws(spark, d)
    shaped = ev.to_adapter(t, fx.adapter_mapping(spark), "scores", keep=["captured_at", "source"])
    outbox.publish(shaped.filter(F.col("source") == "camera").drop("source"), folder)
    outbox.publish(shaped.drop("source"), folder)
    later = F.col("captured_at") + F.make_dt_interval(days=F.lit(1))
    outbox.publish(shaped.drop("source").withColumn("captured_at", later), folder)
    return outbox.delivered(spark, folder).select("adapter", "id", "payload")


@query
def t1_live_scores(spark, d):
    """The last line per leg and player; corrections re-score what they correct."""
    return _last_lines(_arrived(live.live_scores(_throws(spark, d), _utc_games(spark, d), "60 days"), "update"))


def _last_lines(lines: DataFrame) -> DataFrame:
    newest = F.struct("batch", "closed")
    return (
        lines.groupBy("session_id", "started_at", "player_id")
        .agg(F.max_by(F.struct("game_type", "value", "status", "throws"), newest).alias("last"))
        .select("session_id", _plain("started_at"), "player_id", "last.*")
    )


# Throws and games arrive in files of their own, so one side may be as late as all of them.
ALL_TIME = "90 days"


def _arriving(df: DataFrame, time: str) -> DataFrame:
    """A table as a stream, a file for each of a few spans of time, the latest first."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    timed = cut_lineage(df.withColumn(time, F.col(time).cast("timestamp")))
    for part in (2, 1, 0):
        rows = timed.where(F.pmod(F.dayofyear(time), F.lit(3)) == part)
        rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def j2_live_asof_calibration(spark, d):
    """J2 where detections and calibrations both arrive."""
    seen = fx.detections_of(fx.with_keys(fx.event_stream(spark, d, marked=False))).drop("calibration_id", "h")
    calibrations = _arriving(fx.calibrations(spark, d), "validated_at")
    found = _arrived(
        held.live_as_of(
            seen, calibrations, ["session_id"], "captured_at", "validated_at", ["calibration_id"], ALL_TIME, "7 days"
        )
    )
    return found.filter(F.col("session_id") != fx.END_SESSION).select("throw_id", "view", "calibration_id")


@query
def j3_live_asof_game(spark, d):
    """J3 where throws and games both arrive."""
    t = fx.throws_of(fx.with_keys(fx.event_stream(spark, d, marked=False))).select("id", "session_id", "captured_at")
    games = _arriving(fx.games(spark, d), "started_at")
    found = _arrived(
        held.live_as_of(t, games, ["session_id"], "captured_at", "started_at", live.GAME, ALL_TIME, "7 days")
    ).filter(F.col("session_id") != fx.END_SESSION)
    return found.select("id", "game_type", "start_score", "double_out", _plain("started_at"))


@query
def t1_live_scores_arriving_games(spark, d):
    """T1 where the games arrive as well."""
    t = fx.throws_of(fx.with_keys(fx.event_stream(spark, d, marked=False)))
    games = _arriving(fx.games(spark, d), "started_at")
    lines = _arrived(live.live_scores(t, games, "60 days", ALL_TIME, "7 days"))
    return _last_lines(lines)


@query
def t2_once_each(spark, d):
    dirty = fx.dirty_of(_throws(spark, d))
    found = _arrived(sources.once_each(dirty)).filter(F.col("id") != fx.END_ID)
    return found.select("id", "score", "source")


@query
def t2_once_ever(spark, d):
    """All events delivered again sixty days later, long after any watermark."""
    folder = _folder(spark)
    rows = fx.throws_dirty(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    for late in (0, 60):
        again = rows.withColumn("captured_at", F.col("captured_at") + F.make_dt_interval(days=F.lit(late)))
        again.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(again.schema).parquet(f"{folder}/in").withWatermark("captured_at", "1 hour")
        _finish(once.once_ever(stream, folder, f"{folder}/state"))
    return once.admitted(spark, folder, again.schema).select("id", "score", "source")


@query
def t3_session_summary(spark, d):
    found = _arrived(sources.session_summary(_throws(spark, d), "6 hours"))
    found = found.filter(F.col("session_id") != fx.END_SESSION)
    return found.select("session_id", _plain("opened_at"), _plain("closed_at"), "throws", "points")


@query
def t4_live_frame_rate(spark, d):
    frames = fx.frames_of(fx.with_keys(fx.event_stream(spark, d)))
    found = _arrived(sources.live_frame_rate(frames, "60 minutes", "30 minutes"))
    found = found.filter(F.col("runtime") != fx.END_RUNTIME)
    return found.select(
        "runtime", _plain("window_start"), "frames", F.round("frames_per_second", 9).alias("rate")
    )


@query
def t5_live_throws(spark, d):
    frames = fx.frames_of(fx.with_keys(fx.event_stream(spark, d)))
    found = _arrived(live.live_throws(frames, "1 day")).filter(F.col("session_id") != fx.END_SESSION)
    return found.select(
        "session_id", "frame_no", "n_tips", "new_tips", "retrieved", "throws_so_far"
    )


@query
def t6_with_stored_calibration(spark, d):
    seen = fx.detections_of(fx.with_keys(fx.event_stream(spark, d)))
    found = _arrived(sources.with_stored_calibration(seen, fx.calibrations(spark, d)))
    return found.select("throw_id", "view", F.round(F.col("h")[0], 9).alias("h0"))


@query
def t6_with_arriving_calibration(spark, d):
    """Detections and calibrations both arrive; a calibration counts for five days."""
    folder = _folder(spark)
    stored = fx.calibrations(spark, d).withColumn("validated_at", F.col("validated_at").cast("timestamp"))
    stored.filter(F.col("validated_at").isNotNull()).write.parquet(folder)
    arriving = (
        spark.readStream.schema(stored.schema).parquet(folder).withWatermark("validated_at", "40 days")
    )
    seen = fx.detections_of(fx.with_keys(fx.event_stream(spark, d)))
    found = _arrived(sources.with_arriving_calibration(seen, arriving, "5 days"))
    return found.select("throw_id", "view", _plain("validated_at"), F.round(F.col("h")[0], 9).alias("h0"))


@query
def w1_live_sample(spark, d):
    frames = fx.frames_of(fx.with_keys(fx.event_stream(spark, d)))
    found = _arrived(sources.sampled_frames(frames, "6 hours"))
    found = found.filter(F.col("session_id") != fx.END_SESSION)
    return found.select("session_id", _plain("slot_start"), "frame_no")


@query
def t7_forward_live(spark, d):
    folder = _folder(spark)
    grants = fx.adapter_grants(spark, d).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")}
    )
    _finish(
        sources.forward_live(
            _throws(spark, d),
            "scores",
            fx.adapter_mapping(spark),
            grants,
            f"{folder}/outbox",
            f"{folder}/state",
        )
    )
    return outbox.delivered(spark, f"{folder}/outbox", "timestamp").select("adapter", "id", "payload")


@query
def t8_review_queue(spark, d):
    folder = _folder(spark)
    _finish(sources.review_queue(_throws(spark, d), 0.5, f"{folder}/routes", f"{folder}/state"))
    found = spark.read.schema("id string, confidence double, route string").parquet(
        f"{folder}/routes"
    )
    return found.filter(F.col("id") != fx.END_ID)
