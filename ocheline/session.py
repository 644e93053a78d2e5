"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Equi-joins against a hot session or calibration are split by AQE, also
    # where the split costs a later aggregate its partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Collecting a stack trace per column expression dominates the planning of
    # deep expressions such as the X01 fold.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def builder(app_name: str = "ocheline") -> SparkSession.Builder:
    session = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        session = session.config(key, value)
    return session
