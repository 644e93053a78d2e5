"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ocheline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get(SETTING, None)
    if folder is not None:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return _own_folder()


def session_folder(spark: SparkSession) -> str:
    """The folder of this application's tables within the shared one."""
    return f"{shared_folder(spark)}/ocheline-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete the tables of this application; what was built on them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table to the shared folder and go on from there.

    Unlike `DataFrame.checkpoint` this computes the rows once, and what reads
    them prunes columns and knows their size. The tables stay until
    `remove_tables`, since frames that read them may be used at any later time.
    """
    path = f"{session_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
