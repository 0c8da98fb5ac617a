"""Exact top-k search by inner product: a Voronoi join of queries and data.

Components become floor(256 * x). A bounded sample of rows (SAMPLE) serves three ends: its first vectors are pivots, its scores give
every query a bound that k + 1 rows reach, and it tells how much a number of cells would exclude. Queries
and data belong to the cell of their nearest pivot. Summaries of the cells (their radius) bound the scores: with t, the least bound of
a query cell of pivot p and radius R, a data vector x goes there only if p.x + R|x| reaches t, and
p.c + R|c| + r(|p| + R) rules out a whole data cell of pivot c and radius r. Each (query cell, block of queries, salt of data)
is solved locally, at most BLOCK queries and about SALT_ROWS rows at once, and the best of each query are merged.

The number of cells is the one with the least estimated work, copies of data and pairs together: vectors in clusters get many
cells, of which each row reaches a few; where bounds exclude nothing one cell does all, since copies would only add work.
A query is copied once for each salt of its cell, a row once for each block of the cells it reaches.

Of equal vectors only the k + 1 with the smallest ids can be among the k + 1 best of a query, so others don't
travel as data, and equal queries are solved once. Cells are dealt out by block and salt, so a cell with a third of all rows is
solved by many tasks.

Rows: each row is a vector and a candidate of its own, also when its vec_id repeats; a query's own row is no candidate. Vectors that
are null or hold null or non-finite components, and rows with a null vec_id, take no part. A shorter vector counts as filled
up with zeros. Scores must fit 64 bits. An empty table, or one without queries, gives an empty one. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavestrata.llm.store import dropped, partitions, written
from wavestrata.llm.textkit import tidy

K, EVERY = 5, 50
SAMPLE, BLOCK, SALT_ROWS = 2048, 4096, 40_000
_COPY = 200  # sending a row costs about as much as so many scores
_RESULT = "query_id long, rank int, vec_id long, score long"


def _matrix(raw: list[bytes], width: int) -> np.ndarray:
    """One row of integers for each vector, filled up with zeros."""
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in raw), "<i8").reshape(len(raw), width)


def quantized(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): v are the little-endian 64-bit integers floor(256 * x), row a number of the row."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, x in enumerate(batch.column(2)):
                if not x.is_valid or x.values.null_count:
                    continue
                x = np.floor(256 * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    keep.append(i)
                    rows.append(x.astype("<i8").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows, pa.binary())], ["row", "vec_id", "v"])

    rows = vectors.where("vec_id IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding")
    return rows.mapInArrow(tidy(convert), "row long, vec_id long, v binary")


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where all sums are exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64) if most < 2**53 else queries @ data.T


def best(s: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of scores the places of the k best; ties to the smaller id, then the smaller row."""
    for found in s:
        at = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k]) if len(found) > k else np.arange(len(found))
        yield at[np.lexsort((rows[at], ids[at], -found[at]))][:k]


@dataclass
class Cells:
    """Pivots, the radius of the data around them, and the query cells: their radius and least bound."""

    pivots: np.ndarray
    radius: np.ndarray
    asked: np.ndarray
    asked_radius: np.ndarray
    least: np.ndarray

    def wanted(self) -> np.ndarray:
        """[data cell, query cell]: whether the query cell may need anything of the data cell."""
        centre = self.pivots[self.asked]
        size = np.linalg.norm(centre, axis=1)
        bound = self.pivots @ centre.T + self.asked_radius * np.linalg.norm(self.pivots, axis=1)[:, None] + self.radius[:, None] * (size + self.asked_radius)
        return bound >= self.least - _slack(bound)

    def reached(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """[vector, query cell]: whether the vector, of this cell, can reach the least bound of the query cell."""
        most = x @ self.pivots[self.asked].T + self.asked_radius * np.linalg.norm(x, axis=1)[:, None]
        return (most >= self.least - _slack(most)) & self.wanted()[cell]


def _slack(x: np.ndarray) -> np.ndarray:
    return 1e-6 * (1 + np.abs(x))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector and its distance to the pivot."""
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    cell = square.argmin(1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def bounds(q: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k + 1 rows of the sample reach, itself perhaps included; -inf if the sample is smaller."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    s = q @ sample.T
    return np.partition(s, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]


def chosen_cells(sample: np.ndarray, n_asked: int, k: int) -> tuple[np.ndarray, float]:
    """Pivots, as many as make the least estimated work, and the share of (row, query cell) that they leave."""
    distinct = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    found, count = (np.inf, distinct[:1], 1.0), 1
    reach = bounds(sample, sample, k)
    while count <= max(1, len(distinct) // 4):
        pivots = distinct[:count]
        cell, far = nearest(sample, pivots)
        asked = np.unique(cell)
        of = np.searchsorted(asked, cell)
        radius, least = np.zeros(len(asked)), np.full(len(asked), np.inf)
        np.maximum.at(radius, of, far)
        np.minimum.at(least, of, reach)
        whole = np.zeros(count)
        whole[asked] = radius
        share = Cells(pivots, whole, asked, radius, least).reached(sample, cell).mean()
        work = share * (_COPY * max(len(asked), n_asked / BLOCK) + n_asked)
        if work < found[0]:
            found = work, pivots, float(share)
        count *= 2
    return found[1:]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by every, against all rows."""
    spark = vectors.sparkSession
    table = written(quantized(vectors), "vectors")
    is_asked = F.col("vec_id") % every == 0
    n_asked, n_rows, widest = table.agg(F.count_if(is_asked), F.count("*"), F.max(F.octet_length("v"))).first()
    if not n_asked:
        return spark.createDataFrame([], _RESULT)
    width = widest // 8
    numbers = lambda column: _matrix(column.to_pylist(), width)
    data = table.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))).where(F.col("n") <= k + 1).select("row", "vec_id", "v")
    data = written(data, "data")
    distinct = written(table.where(is_asked).groupBy("v").agg(F.min("row").alias("query")), "distinct")
    asking = written(table.where(is_asked).join(distinct, "v").select("query", F.col("vec_id").alias("query_id"), F.col("row").alias("own")), "asking")
    sample = _matrix([bytes(r.v) for r in data.orderBy(F.xxhash64("row")).limit(SAMPLE).collect()], width).astype(np.float64)
    pivots, share = chosen_cells(sample, n_asked, k)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = numbers(batch.column(0)).astype(np.float64)
            cell, far = nearest(q, pivots)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), pa.array(bounds(q, sample, k)), *batch.columns], ["cell", "far", "reach", "v", "query"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.full(len(pivots), -1.0)
        for batch in batches:
            np.maximum.at(radius, *nearest(numbers(batch.column(0)).astype(np.float64), pivots))
        used = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(radius[used])], ["cell", "radius"])

    queries = written(distinct.select("v", "query").mapInArrow(tidy(ask), "cell long, far double, reach double, v binary, query long"), "queries")
    groups = sorted(map(tuple, queries.groupBy("cell").agg(F.max("far"), F.min("reach"), F.count("*")).collect()))  # a row a cell
    cells = Cells(pivots, np.zeros(len(pivots)), *(np.array(c) for c in list(zip(*groups, strict=True))[:3]))
    for r in data.select("v").mapInArrow(tidy(around), "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        cells.radius[r.cell] = r.radius
    blocks = np.array([-(-g[3] // BLOCK) for g in groups])
    salts = max(1, -(-2 * partitions(spark) // int(blocks.sum())), -(-int(share * n_rows) // SALT_ROWS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = numbers(batch.column(2)).astype(np.float64)
            reached = cells.reached(x, nearest(x, pivots)[0])
            for g in np.flatnonzero(reached.any(0)).tolist():
                few = batch.take(pa.array(np.flatnonzero(reached[:, g])))
                for b in range(blocks[g]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(few.num_rows, cells.asked[g])), pa.array(np.full(few.num_rows, b)), *few.columns], ["cell", "block", "row", "vec_id", "v"])

    sent = data.select("row", "vec_id", "v").mapInArrow(tidy(send), "cell long, block long, row long, vec_id long, v binary")
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    block_of = F.element_at(F.create_map(*[F.lit(int(x)) for c, b in zip(cells.asked, blocks, strict=True) for x in (c, b)]), F.col("cell").cast("int"))
    dealt = queries.select("cell", F.pmod(F.xxhash64("query"), block_of).alias("block"), "query", "v", "reach")
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            query, reach, ids, rows = left["query"].to_numpy(), left["reach"].to_numpy(), right["vec_id"].to_numpy(), right["row"].to_numpy()
            x = numbers(right["v"])
            for a in range(0, len(query), 128):
                s = scores(numbers(left["v"].slice(a, 128)), x)
                for i, at in enumerate(best(s, ids, rows, k + 1), a):
                    at = at[s[i - a, at] >= reach[i]]  # k + 1 rows of the sample reach that already
                    out.append((np.full(len(at), query[i]), rows[at], ids[at], s[i - a, at]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "row", "vec_id", "score"])

    keys = ("cell", "block", "salt")
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query long, row long, vec_id long, score long")
    by_score = [F.desc("score"), "vec_id", "row"]
    lists = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*by_score))).where(F.col("n") <= k + 1).drop("n")
    lists = written(lists, "lists")
    dropped(distinct, queries, data, table)
    own = lists.join(asking, "query").where("row <> own").withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(*by_score)))
    return own.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
