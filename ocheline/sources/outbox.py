"""The outbox third parties read, each event once per adapter.

Every delivery writes a folder of its own, so several may run at once. What two
of them write at the same time lies there twice, as the same event; `delivered`
gives it once, always the same one of the two.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTBOX = "id string, payload string, captured_at {ts}, delivery string, adapter string, bucket int"
# Ids are dealt out to so many folders of an adapter, so a small delivery reads few.
BUCKETS = 64


def written(spark: SparkSession, path: str, ts: str = "timestamp_ntz") -> DataFrame:
    """All rows of all deliveries; none if there is no outbox yet.

    `ts` is the type of `captured_at` in the delivered events.
    """
    schema = OUTBOX.format(ts=ts)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delivered(spark: SparkSession, path: str, ts: str = "timestamp_ntz") -> DataFrame:
    """(id, payload, captured_at, adapter, bucket): each (adapter, id) once, whoever wrote it.

    Of several rows the first by (captured_at, payload) counts, which does not
    depend on the order of deliveries.
    """
    first = F.min(F.struct("captured_at", "payload"))
    return (
        written(spark, path, ts)
        .groupBy("adapter", "bucket", "id")
        .agg(first.alias("_first"))
        .select("id", "_first.payload", "_first.captured_at", "adapter", "bucket")
    )


def publish(events: DataFrame, path: str) -> None:
    """Append the events (adapter, id, payload, captured_at) not yet delivered.

    Repeating a delivery, in whole or in part, adds nothing, also with another
    time. Of several rows of one id the first by (captured_at, payload) counts.
    Only the buckets that occur in `events` are read back from the outbox. Other
    deliveries may run at the same time.
    """
    first = F.min(F.struct("captured_at", "payload"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    fresh = (
        events.groupBy("adapter", "id")
        .agg(first.alias("_first"))
        .select("adapter", bucket.alias("bucket"), "id", "_first.payload", "_first.captured_at")
    )
    ts = events.schema["captured_at"].dataType.simpleString()
    # At most BUCKETS rows for each adapter.
    touched = fresh.select("adapter", "bucket").distinct()
    known = (
        written(events.sparkSession, path, ts)
        .join(touched, ["adapter", "bucket"], "left_semi")
        .select("adapter", "bucket", "id")
    )
    (
        fresh.join(known, ["adapter", "bucket", "id"], "left_anti")
        .hint("rebalance", "adapter", "bucket")
        .write.partitionBy("adapter", "bucket")
        .parquet(f"{path}/delivery={uuid.uuid4().hex}")
    )
