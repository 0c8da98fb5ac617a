"""Catalogue work: duplicates, ids, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_known(files: DataFrame, recordings: DataFrame, by: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """files with already_imported: whether a recording agrees in all columns of by."""
    known = recordings.select(*by).distinct().withColumn("already_imported", F.lit(True))
    return files.join(known, list(by), "left").withColumn("already_imported", F.coalesce("already_imported", F.lit(False)))


def fresh(files: DataFrame, recordings: DataFrame, by: tuple[str, ...] = ("sha256",)) -> DataFrame:
    return files.join(recordings.select(*by), list(by), "left_anti")


def assigned_ids(rows: DataFrame, last_id: int | None, order: str, name: str = "rec_id") -> DataFrame:
    """rows with ids after last_id in the order given; gaps below are not filled.

    Ranges of the order are numbered on their own and then shifted by how many rows come before,
    so no task sees all rows. order must be unique.
    """
    from wavestrata.operators.ranking import row_numbers

    return row_numbers(rows, order, name, start=(-1 if last_id is None else last_id) + 1)


def snapshot(df: DataFrame, text: int = 32, items: int = 32) -> DataFrame:
    """df with strings cut to so many characters and arrays and maps to so many items."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "string":
            c = F.substring(c, 1, text)
        elif kind == "array":
            c = F.slice(c, 1, items)
        elif kind == "map":
            c = F.map_from_entries(F.slice(F.array_sort(F.map_entries(c)), 1, items))
        elif kind == "binary":
            c = F.substring(c, 1, items)
        out.append(c.alias(f.name))
    return df.select(*out)


def difference(left: DataFrame, right: DataFrame, key: str, values: tuple[str, ...] = ()) -> DataFrame:
    """(key, status): missing on the right, extra on it, or changed in one of the values."""
    x = left.select(key, F.struct(F.lit(True).alias("is"), *values).alias("x"))
    y = right.select(key, F.struct(F.lit(True).alias("is"), *values).alias("y"))
    both = x.join(y, key, "full_outer")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")


def compression_ratio(original: Column, stored: Column) -> Column:
    """original / stored, 0 where nothing is stored."""
    return F.when(stored > 0, original / stored).otherwise(0.0)


def batch_summary(results: DataFrame, by: str, loud: Column, copied: Column, recording: str) -> DataFrame:
    """Per group: rows over a level, rows kept as they are, and distinct recordings."""
    return results.groupBy(by).agg(F.count_if(loud).alias("loud"), F.count_if(copied).alias("copied"), F.countDistinct(recording).alias("n_recordings"))
