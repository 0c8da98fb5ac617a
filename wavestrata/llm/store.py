"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/wavestrata-shared"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() has made and nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, _written.pop(df)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lower the session's limit for Arrow batches to so many bytes, if it is higher.

    The limit bounds what JVM and Python hold of long texts at once; at the usual 64 MB a task holds several times that. Plans read it
    when they run, after the caller has got its DataFrame, so it stays lowered.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read back from a Parquet table in the shared folder.

    This cuts the lineage: when an executor is lost, later stages read the table again.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files that only this computation read
    table = spark.read.schema(schema).parquet(path)
    _written[table] = path
    return table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
