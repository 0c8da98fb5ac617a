"""Fixed segments of a stream of samples, and ingest of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wavestrata.functions.signal import rms


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, rms) of tumbling windows on ts; batch and stream alike, with a watermark if late is given."""
    rows = events.withWatermark("ts", late) if late else events
    sums = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), rms(F.col("value")).alias("rms"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "rms")


def watch(spark: SparkSession, folder: str, checkpoint: str, ingest: Callable[[DataFrame], None], pattern: str = "*.wav") -> StreamingQuery:
    """Give every new file of a folder to ingest once, as (path, modificationTime, length, content); ends when all are taken."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    query = files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest(batch))
    return query.start()
