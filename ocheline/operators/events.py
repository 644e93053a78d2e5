"""Throw events: union, checks, routing, assembly, projection, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocheline.functions import board, rules
from ocheline.schemas import THROW_EVENT


def union_sources(camera: DataFrame, manual: DataFrame) -> DataFrame:
    """Camera and manual events as one input."""
    return camera.unionByName(manual)


def validate_throws(throws: DataFrame) -> DataFrame:
    """Add the names of the rules each row breaks."""
    return throws.withColumn("violations", rules.violations())


def split_valid(throws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and the quarantined ones with their reasons."""
    # Rows of a generator: filters on them are not put together again out of the columns below.
    checked = validate_throws(throws).withColumn("violations", F.explode(F.array("violations")))
    good = checked.filter(F.size("violations") == 0).drop("violations")
    return good, checked.filter(F.size("violations") > 0)


def vendor_leak(raw: DataFrame, json_column: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Fields of a raw JSON event that the contract does not know, nested ones by path.

    `allowed` names top-level fields; without it the contract is THROW_EVENT,
    whose objects are looked into as well ('impact.vendorField').
    """
    names = list(allowed) if allowed is not None else THROW_EVENT.fieldNames()
    top = F.from_json(F.col(json_column), "map<string,string>")

    def unknown(fields: Column, known: Sequence[str]) -> Column:
        keys = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
        return F.array_except(keys, F.array(*[F.lit(n) for n in known]))

    found = [unknown(top, names)]
    for field in THROW_EVENT.fields if allowed is None else ():
        if isinstance(field.dataType, T.StructType):
            inner = F.from_json(top[field.name], "map<string,string>")
            found.append(
                F.transform(
                    unknown(inner, field.dataType.fieldNames()), _prefixed(field.name)
                )
            )
    leaked = F.array_sort(F.concat(*found))
    return raw.withColumn("leaked", leaked).filter(F.size("leaked") > 0)


def _prefixed(name: str) -> Callable[[Column], Column]:
    return lambda key: F.concat(F.lit(f"{name}."), key)


def route_confidence(throws: DataFrame, threshold: float = 0.5) -> DataFrame:
    """P4: 'review' below the threshold or without a confidence, else 'accept'."""
    accepted = F.col("confidence") >= F.lit(float(threshold))
    return throws.withColumn("route", F.when(accepted, "accept").otherwise("review"))


def usable_datasets(catalogue: DataFrame, licences: DataFrame) -> DataFrame:
    """Datasets whose licence is known and permits commercial use."""
    return catalogue.join(licences.filter("commercial"), "licence", "left_semi")


def assemble_throws(
    mapped: DataFrame, identity: Sequence[str] = ("session_id", "frame_no", "calibration_id")
) -> DataFrame:
    """Throw events from board points that carry segment and multiplier.

    The id is a digest of the `identity` columns (session, frame and
    calibration), so a repeated run gives the same event the same id.
    """
    seg, mult = F.col("segment"), F.col("multiplier")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in identity])
    return mapped.select(
        F.sha2(key, 256).alias("id"),
        "session_id",
        "player_id",
        F.lit(None).cast("string").alias("turn_id"),
        "captured_at",
        "x",
        "y",
        "segment",
        "multiplier",
        board.score(seg, mult).alias("score"),
        board.notation(seg, mult).alias("notation"),
        "confidence",
        "calibration_id",
        F.lit("camera").alias("source"),
        F.lit(None).cast("string").alias("correction_of"),
    )


def nest_throws(throws: DataFrame) -> DataFrame:
    """The flat rows in the nested form in which events are exchanged."""
    when = F.date_format(F.col("captured_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = "" if throws.schema["captured_at"].dataType.simpleString() == "timestamp_ntz" else "Z"
    if not zone:
        stamp = when
    else:
        stamp = F.concat(
            F.date_format(
                F.to_utc_timestamp("captured_at", F.current_timezone()),
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            ),
            F.lit(zone),
        )
    return throws.select(
        "id",
        F.col("session_id").alias("sessionId"),
        F.col("player_id").alias("playerId"),
        F.col("turn_id").alias("turnId"),
        stamp.alias("capturedAt"),
        F.struct(F.col("x").alias("xNormalized"), F.col("y").alias("yNormalized")).alias("impact"),
        F.struct("segment", "multiplier", "score", "notation", "confidence").alias("detected"),
        F.col("calibration_id").alias("calibrationId"),
        "source",
        F.col("correction_of").alias("correctionOf"),
    )


def captured_instant(text: Column) -> Column:
    """ISO-8601 to an instant; a time without offset is UTC. Null if it is neither."""
    has_zone = text.rlike(r"[T ]\d{1,2}:.*(Z|[+-]\d{2}(:?\d{2})?)$")
    return F.try_to_timestamp(F.when(has_zone, text).otherwise(F.concat(text, F.lit("Z"))))


def flatten_throws(events: DataFrame) -> DataFrame:
    """The nested events as flat rows with a parsed time."""
    return events.select(
        "id",
        F.col("sessionId").alias("session_id"),
        F.col("playerId").alias("player_id"),
        F.col("turnId").alias("turn_id"),
        captured_instant(F.col("capturedAt")).alias("captured_at"),
        F.col("impact.xNormalized").alias("x"),
        F.col("impact.yNormalized").alias("y"),
        F.col("detected.segment").alias("segment"),
        F.col("detected.multiplier").alias("multiplier"),
        F.col("detected.score").alias("score"),
        F.col("detected.notation").alias("notation"),
        F.col("detected.confidence").alias("confidence"),
        F.col("calibrationId").alias("calibration_id"),
        "source",
        F.col("correctionOf").alias("correction_of"),
    )


def adapter_fields(
    mapping: DataFrame | Sequence[tuple[str, str]], adapter: str
) -> list[tuple[str, str]]:
    """The (canonical, vendor) names of one adapter."""
    if not isinstance(mapping, DataFrame):
        return list(mapping)
    rows = mapping.filter(F.col("adapter") == adapter).select("canonical", "vendor").distinct()
    return sorted((r["canonical"], r["vendor"]) for r in rows.collect())


def to_adapter(
    throws: DataFrame,
    mapping: DataFrame | Sequence[tuple[str, str]],
    adapter: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The fields an adapter wants, under its names, as JSON; `keep` is passed on.

    `mapping` has rows (adapter, canonical, vendor), or is the list of pairs
    itself. It names columns of one table, so it is read on the driver; a name
    that is no column is an error.
    """
    pairs = adapter_fields(mapping, adapter)
    unknown = sorted({canonical for canonical, _ in pairs} - set(throws.columns))
    if unknown:
        raise ValueError(f"the mapping of {adapter} names unknown columns: {', '.join(unknown)}")
    fields = [F.col(canonical).alias(vendor) for canonical, vendor in pairs]
    return throws.select(
        F.lit(adapter).alias("adapter"),
        F.col("id"),
        F.to_json(F.struct(*fields)).alias("payload"),
        *keep,
    )


def dedupe_throws(throws: DataFrame) -> DataFrame:
    """The first delivery of each id, by time and then payload hash.

    Spark limits each group before the shuffle for `row_number() = 1`, so an id
    that was redelivered very often costs one row per task, not one task.
    """
    payload = [c for c in throws.columns if c not in ("id", "captured_at")]
    first = Window.partitionBy("id").orderBy("captured_at", "_hash")
    return (
        throws.withColumn("_hash", F.xxhash64(*payload))
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_n", "_hash")
    )


def orphan_calibration(throws: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Throws whose calibration does not exist."""
    return throws.join(calibrations.select("calibration_id"), "calibration_id", "left_anti")


def orphan_corrections(throws: DataFrame) -> DataFrame:
    """Corrections that name no event."""
    known = throws.select(F.col("id").alias("correction_of"))
    return throws.filter(F.col("correction_of").isNotNull()).join(
        known, "correction_of", "left_anti"
    )


def authorised(throws: DataFrame, grants: DataFrame, adapter: str | None = None) -> DataFrame:
    """Throws captured while their session is granted (to `adapter`)."""
    valid = grants if adapter is None else grants.filter(F.col("adapter") == adapter)
    valid = valid.select(F.col("session_id").alias("_session"), "valid_from", "valid_to")
    inside = (F.col("session_id") == F.col("_session")) & F.col("captured_at").between(
        F.col("valid_from"), F.col("valid_to")
    )
    return throws.join(valid, inside, "left_semi")
