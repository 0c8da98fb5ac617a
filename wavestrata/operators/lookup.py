"""Range lookups: requests for samples or bytes against frames and chunks, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of rows with equal key whose inclusive ranges overlap.

    Both sides are dealt into buckets of the axis, so long recordings spread over many tasks and
    no task compares more than what shares a bucket; a pair is kept in the first bucket it shares.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    (l0, l1), (r0, r1) = left_range, right_range
    x = left.where(F.col(l0) <= F.col(l1)).withColumn("__bucket", buckets(l0, l1))
    y = right.where(F.col(r0) <= F.col(r1)).withColumn("__bucket", buckets(r0, r1))
    both = x.join(y, [key, "__bucket"]).where((F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)))
    first = F.greatest(F.floor(F.col(l0) / bucket), F.floor(F.col(r0) / bucket))
    return both.where(F.col("__bucket") == first).drop("__bucket")


def frame_range(requests: DataFrame, frames: DataFrame, ahead: int = 1, overlap: int = 0, frame: int | None = None, bucket: int = 1 << 24) -> DataFrame:
    """First and last frame (s, e) of each request; both null if its recording has no frames or s > e.

    s is the frame that holds start (0 before all), e the one that holds end plus ahead, at most the
    last one; overlap moves s back. With frame, the samples of the last frame, start and end are
    first cut to the recording. frame_no counts from 0 in the order of sample_pos, so sorted streams
    of frames and requests answer all of them; no request is paired with frames. Each row of requests gives one row, equal ones too.
    """
    size = frames.groupBy("rec_id").agg(F.count("*").alias("__n"), F.max("sample_pos").alias("__last"))
    found = requests.withColumn("__row", F.monotonically_increasing_id()).join(size, "rec_id", "left")
    a, b = F.col("start_sample"), F.col("end_sample")
    if frame is not None:
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.col("__last") + frame - 1)
    found = found.withColumns({"__a": a, "__b": b})
    points = found.select("*", F.posexplode(F.array("__a", "__b")).alias("__which", "__at"))
    held = latest_at(points, frames.select("rec_id", "sample_pos", "frame_no"), "rec_id", "__at", "sample_pos", "frame_no", bucket)
    upto = lambda k: F.coalesce(F.max(F.when(F.col("__which") == k, F.col("frame_no") + 1)), F.lit(0))
    counted = held.groupBy(*found.columns).agg(upto(0).alias("__to_a"), upto(1).alias("__to_b"))
    first = F.greatest(F.lit(0), F.col("__to_a") - 1)
    last = F.least(F.col("__to_b") + (ahead - 1), F.col("__n") - 1)
    ok = F.col("__n").isNotNull() & (first <= last)
    moved = F.greatest(F.lit(0), first - overlap)
    return counted.select(*requests.columns, F.when(ok, moved).alias("first_frame"), F.when(ok, last).alias("last_frame"))


def latest_at(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str, bucket: float) -> DataFrame:
    """left with the right value of the greatest since <= at, null if there is none; the greatest value of equal ones.

    The axis (numbers, or times in seconds) is cut into buckets. Both sides are sorted once, in one stream for each key and bucket, so a
    key with very many rows spreads over tasks; what a bucket lacks comes from the last row before it, one row a bucket.
    A null at finds nothing.
    """
    def place(df: DataFrame, c: str) -> Column:
        axis = F.col(c).cast("timestamp") if isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.DateType)) else F.col(c)
        return F.floor(axis.cast("double") / bucket)

    kind = right.schema[value].dataType
    a = left.where(F.col(at).isNotNull()).select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v"), place(left, at).alias("__bucket"))
    b = right.where(F.col(since).isNotNull()).select(F.col(key), F.col(since).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), place(right, since).alias("__bucket"))
    ends = b.groupBy(key, "__bucket").agg(F.max(F.struct("__t", "__v")).alias("__end"))
    asked = a.select(key, "__bucket").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    marks = ends.unionByName(asked).groupBy(key, "__bucket").agg(F.max("__end").alias("__end"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(key, "__bucket", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(key, "__bucket").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(upto)
    own = both.withColumn("__found", last).where("__side = 1")
    marks = marks.withColumnsRenamed({key: "__key", "__bucket": "__of"})
    joined = own.join(marks, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__of")), "left")
    got = F.when(F.col("__found").isNotNull(), F.col("__found.v")).otherwise(F.col("__before.__v"))
    nothing = left.where(F.col(at).isNull()).select("*", F.lit(None).cast(kind).alias(value))
    return joined.select(*left.columns, got.alias(value)).unionByName(nothing)


def trimmed(samples: Column, frame_start: Column, start: Column, end: Column) -> Column:
    """The samples start to end (inclusive) of an array whose first sample is number frame_start."""
    off = start - frame_start
    need = F.greatest(F.lit(0), end - start + 1 + F.least(off, F.lit(0)))
    off = F.greatest(off, F.lit(0))
    return F.when(off >= F.size(samples), F.slice(samples, 1, 0)).otherwise(F.slice(samples, (off + 1).cast("int"), need.cast("int")))


def chunks_covering(requests: DataFrame, chunks: DataFrame, key: str = "rec_id", size: str | int = 1 << 20) -> DataFrame:
    """Chunks that hold a byte of [byte_from, byte_to) of each request, found by their numbers.

    size is the bytes of a chunk (only the last of a content has fewer), a number or a column of requests. A request meets only the chunks it needs.
    """
    n = f"`{size}`" if isinstance(size, str) else str(size)
    numbers = F.explode(F.expr(f"sequence(cast(greatest(byte_from, 0) div {n} as int), cast((byte_to - 1) div {n} as int))"))
    wanted = requests.where("greatest(byte_from, 0) < byte_to").withColumn("chunk_no", numbers)
    return wanted.join(chunks, [key, "chunk_no"]).where((F.col("byte_end") > F.col("byte_from")) & (F.col("byte_start") < F.col("byte_to")))


def random_requests(recordings: DataFrame, per_recording: int, samples: int, seed: int = 12345) -> DataFrame:
    """Requests for ranges of so many samples at places drawn by a hash of recording, number and seed."""
    each = recordings.where(F.col("n_samples") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_recording - 1))))
    free = F.greatest(F.col("n_samples") - samples, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("rec_id", "k", F.lit(seed)), free)
    return each.select((F.col("rec_id") * per_recording + F.col("k")).alias("request_id"), "rec_id", start.alias("start_sample"), F.least(start + samples, F.col("n_samples")).alias("end_exclusive")).select("request_id", "rec_id", "start_sample", (F.col("end_exclusive") - 1).alias("end_sample"))
