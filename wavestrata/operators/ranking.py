"""Numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_numbers(rows: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """rows with numbers from start in rising order, null first; order must be unique.

    The order is cut at quantiles into as many ranges as there are shuffle partitions; the driver holds
    one count a range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(rows.schema[order].dataType, T.NumericType):
        cuts = sorted(set(rows.approxQuantile(order, [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    else:  # quantiles of a bounded sample by hash
        picked = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(16 * n).collect())
        cuts = sorted({picked[len(picked) * k // n] for k in range(1, n)}) if picked else []
    placed = rows.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(_below(F.col(order), cuts)))
    counts = {r[0]: r[1] for r in placed.groupBy("__range").count().collect()}
    offsets, total = [], start
    for k in range(-1, len(cuts) + 1):
        offsets.append(total)
        total += counts.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("__range") + 2)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(order).asc_nulls_first()))
    return placed.withColumn(name, (own - 1 + offset).cast("long")).drop("__range")


def _below(value: Column, cuts: list) -> Column:
    """How many of the rising cuts are below the value, by halving."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts])

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        left = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(array, middle) < value, right).otherwise(left)

    begin = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), begin, halve)["low"]
