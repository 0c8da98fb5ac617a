"""Frame indexes: positions, sizes, statistics and validation, one row a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AAC_FRAME = 1024
AAC_LONGEST_FRAME = 8192


def numbered(rows: DataFrame, key: str, order: str, name: str = "frame_no") -> DataFrame:
    """rows with their number from 0 within the recording; order must be unique there."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def fixed_positions(frames: DataFrame, frame: int = AAC_FRAME) -> DataFrame:
    """Sample positions of frames that all hold the same number of samples."""
    return frames.withColumn("sample_pos", F.col("frame_no") * frame)


def accumulated(frames: DataFrame, key: str, order: str, n: str = "n_samples", name: str = "sample_pos") -> DataFrame:
    """Positions as the sum over all earlier frames; computed once, when the index is built."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")))


def sized(frames: DataFrame, key: str, offset: str, total: str, name: str = "frame_size") -> DataFrame:
    """Frame sizes as the distance to the next offset, to the end of the stream for the last frame."""
    following = F.lead(offset).over(Window.partitionBy(key).orderBy(offset))
    return frames.withColumn(name, F.coalesce(following, F.col(total)) - F.col(offset))


def statistics(frames: DataFrame, key: str = "rec_id", rate: int | Column | None = 48_000) -> DataFrame:
    """Per recording: frames, samples, duration, and size minimum, maximum, mean and population deviation.

    rate is a number or a column of the key; if it is None, frames has a column rate.
    """
    last = F.max_by(F.struct("sample_pos", "n_samples"), "sample_pos")
    own = F.max("rate") if rate is None else F.lit(None)
    sums = frames.groupBy(key).agg(
        own.alias("__rate"),
        F.count("*").alias("total_frames"), last.alias("last"), F.min("frame_size").alias("min_size"), F.max("frame_size").alias("max_size"),
        F.avg("frame_size").alias("mean_size"), F.stddev_pop("frame_size").alias("std_size"),
    )
    total = F.col("last.sample_pos") + F.col("last.n_samples")
    rate = F.col("__rate") if rate is None else F.lit(rate) if isinstance(rate, int) else rate
    return sums.withColumns({"total_samples": total, "duration_ms": F.floor(total * 1000 / rate).cast("long")}).drop("last", "__rate")


def validated(frames: DataFrame, key: str = "rec_id", longest: int = AAC_LONGEST_FRAME) -> DataFrame:
    """Per recording: positions never fall, frames lie within the stream, sizes are from 1 to longest; all of it is valid.

    frames needs total_bytes, the size of the stream.
    """
    order = Window.partitionBy(key).orderBy("frame_no")
    rising = F.coalesce(F.col("sample_pos") >= F.lag("sample_pos").over(order), F.lit(True))
    checked = frames.withColumn("rising", rising)
    inside = (F.col("byte_offset") >= 0) & (F.col("byte_offset") < F.col("total_bytes"))
    sums = checked.groupBy(key).agg(F.bool_and("rising").alias("monotonic"), F.bool_and(inside).alias("in_bounds"), F.bool_and(F.col("frame_size").between(1, longest)).alias("sizes_ok"))
    return sums.withColumn("valid", F.col("monotonic") & F.col("in_bounds") & F.col("sizes_ok"))


def rising_count(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key, how many rows there are and how many exceed the one before: of page numbers or positions that should rise, all but the first."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__before", before).groupBy(key).agg(F.count("*").alias("frames"), F.count_if(F.col(value) > F.col("__before")).alias("louder"))


def sequence_gaps(pages: DataFrame, key: str = "rec_id", number: str = "page_no", order: str = "byte_offset") -> DataFrame:
    """(key, page, expected, found) of each page whose number is not one more than that of the page before; the first may have any."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(order))
    checked = pages.withColumn("expected", before + 1)
    return checked.where(F.col(number) != F.col("expected")).select(key, F.col(order).alias("page"), "expected", F.col(number).alias("found"))


def pattern_count(text: Column, pattern: str) -> Column:
    """How many matches of the pattern, one after the other, a text or hex string has."""
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def adaptive_chunk(n: Column, preferred: int = 20_000, least: int = 5_000, most_chunks: int = 50, highest: int = 100_000) -> Column:
    """Index chunk length in frames for an index of n frames."""
    small = F.greatest(F.lit(preferred // 2), F.floor(n / 4).cast("long"))
    large = F.greatest(F.greatest(F.lit(least), F.floor(n / most_chunks).cast("long")), F.least(F.lit(preferred), F.floor(n / 20).cast("long")))
    chosen = F.when(n <= 5_000, n).when(n <= 50_000, small).otherwise(large)
    return F.least(F.lit(highest), F.greatest(F.lit(least), chosen)).cast("long")


def split_chunks(blobs: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """(key, chunk_no, byte_start, byte_end, payload): the content in pieces of size bytes; an empty one has no piece."""
    each = blobs.withColumn("__total", F.octet_length(content)).where("__total > 0")
    each = each.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("__total") - 1) / size).cast("int"))))
    start = F.col("chunk_no").cast("long") * size
    payload = F.substring(F.col(content).cast("binary"), (start + 1).cast("int"), F.lit(size))
    return each.select(key, "chunk_no", start.alias("byte_start"), F.least(start + size, F.col("__total").cast("long")).alias("byte_end"), payload.alias("payload"))
