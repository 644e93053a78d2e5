"""Events of a stream once for ever: an index of ids on disk, with Bloom filters."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

INDEX = "id string, bucket int, batch bigint"
# Ids are dealt out to so many folders, so a small batch looks into few.
BUCKETS = 64
# Up to so many ids of a batch are looked for by value, which lets Parquet skip what their
# Bloom filters rule out; more are joined.
LOOKED_UP = 2_000
_IN_LIMIT = "spark.sql.parquet.pushdown.inFilterThreshold"


def seen_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, bucket, batch) of all ids that came so far; none if there is no index yet."""
    try:
        return spark.read.schema(INDEX).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def _known(first: DataFrame, index: DataFrame) -> DataFrame:
    """The ids of `first` (id, bucket, …) that are in the index."""
    asked = first.select("id", "bucket").limit(LOOKED_UP + 1).collect()
    if len(asked) > LOOKED_UP:
        return index.select("id")
    ids = [r["id"] for r in asked]
    buckets = sorted({r["bucket"] for r in asked})
    return index.where(F.col("bucket").isin(buckets) & F.col("id").isin(ids)).select("id")


def admit(batch: DataFrame, number: int, index: str, out: str) -> None:
    """Write the events of a batch whose ids never came before to `out`, and their ids to `index`.

    Of several rows of an id in a batch the first by time and payload counts.
    A batch that is repeated replaces what it wrote, and does not see its own ids.
    """
    spark = batch.sparkSession
    before = spark.conf.get(_IN_LIMIT)
    spark.conf.set(_IN_LIMIT, str(LOOKED_UP))
    try:
        columns = [c for c in batch.columns if c not in ("id", "captured_at")]
        order = F.struct("captured_at", F.xxhash64(*columns).alias("_h"), *columns)
        first = batch.groupBy("id").agg(F.min(order).alias("_first")).select(
            "id",
            F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
            "_first.captured_at",
            *[F.col(f"_first.{c}").alias(c) for c in columns],
        )
        first = first.persist()
        known = _known(first, seen_ids(spark, index).where(F.col("batch") != number))
        fresh = first.join(known, "id", "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema("id string").parquet(f"{out}/batch={number}")
        (
            written.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
            .withColumn("batch", F.lit(number).cast("bigint"))
            .hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("parquet.bloom.filter.enabled#id", "true")
            .partitionBy("bucket", "batch")
            .parquet(index)
        )
        first.unpersist()
    finally:
        spark.conf.set(_IN_LIMIT, before)


def once_ever(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """T2 without a limit in time: each id once, however late it is delivered again.

    Events lie in `path`/events, the index of ids in `path`/ids. Nothing is held
    in memory or state: the index grows by an id for each event, and a batch
    reads of it what Bloom filters and buckets leave.
    """

    def run(batch: DataFrame, number: int) -> None:
        admit(batch, number, f"{path}/ids", f"{path}/events")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def admitted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The events that `once_ever` let through."""
    return spark.read.schema(schema).parquet(f"{path}/events")
