"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters divided by the share it has. How often a
document is repeated is a Poisson number with that mean: uniform numbers seeded by a hash of the
document's id go through the inverse distribution function, so the result depends on ids and seed alone.
Rates over _STEP are drawn as a sum of several numbers, so the tables of the distribution stay short.
The copies are then dealt to partitions by a hash of id and copy and sorted by it: a global shuffle.

DataFrame functions only. The rates are one row per weight given, so the broadcast is bounded by
the parameter; a source with a third of all rows is dealt out like any other.

Rows: documents of a source without a weight, or of none, keep a rate of 1 (one copy each). Null texts have
no characters; a weighted source without characters keeps rate 1. Rows with equal ids get equal numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestrata.llm.store import partitions

_STEP = 16.0
WEIGHTS = {f"src{k}": 1.0 for k in range(20)}
SEED = 7


def poisson_table(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where it is 1 in double precision."""
    term = total = math.exp(-rate)
    table = [total]
    while total < 1 and term > 1e-18:
        term *= rate / len(table)
        total += term
        table.append(total)
    return table


def source_rates(docs: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    mass = docs.where(F.col("source").isin(list(weights))).groupBy("source").agg(F.sum(F.char_length("text")).alias("n"))
    mass = {r.source: r.n for r in mass.collect() if r.n}  # one row a weight at most
    total, whole = sum(mass.values()), sum(weights[s] for s in mass)
    return {s: weights[s] / whole * total / n for s, n in mass.items()} if whole else {}


def uniform(seed: int, *parts) -> F.Column:
    """A number from 0 to 1 (excluded) with 52 bits of an MD5 hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(docs: DataFrame, weights: dict[str, float], seed: int = SEED) -> DataFrame:
    """docs, each as many times as drawn, in random order; adds copy (from 1) and shuffle_key, which replace such columns."""
    docs = docs.drop("copy", "shuffle_key")
    rates = source_rates(docs, weights)
    tables = []
    for s, rate in rates.items():
        steps = max(1, math.ceil(rate / _STEP))
        tables.append((s, steps, poisson_table(rate / steps)))
    draws = docs.sparkSession.createDataFrame(tables, "__source string, __steps int, __table array<double>")
    both = docs.join(F.broadcast(draws), F.col("source") == F.col("__source"), "left")  # one row a weight at most
    one = lambda step: F.size(F.filter("__table", lambda p: p <= uniform(seed, F.col("doc_id"), step)))
    drawn = F.aggregate(F.sequence(F.lit(1), "__steps"), F.lit(0), lambda n, step: n + one(step))
    times = F.coalesce(F.when(F.col("__source").isNotNull(), drawn), F.lit(1))
    copies = both.withColumn("__times", times).where("__times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "__times")))
    keyed = copies.withColumn("shuffle_key", uniform(seed + 1, F.col("doc_id"), F.col("copy")))
    dealt = keyed.select(*docs.columns, "copy", "shuffle_key").repartition(partitions(docs.sparkSession), "shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, SEED)


def mixing_sql(documents: str = "documents", weights: dict[str, float] = WEIGHTS, seed: int = SEED) -> str:
    """DuckDB SQL for mix_sources over a table with the columns of documents."""
    values = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in weights.items())
    unit = "('0x' || substr(md5({}), 1, 13))::BIGINT / {}::DOUBLE".format("{}", 2**52)
    return f"""
WITH weights(source, weight) AS (VALUES {values}),
mass AS (SELECT w.source, any_value(w.weight) AS weight, sum(length(d.text))::DOUBLE AS n FROM {documents} d JOIN weights w USING (source) GROUP BY w.source HAVING sum(length(d.text)) > 0),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM mass) * (SELECT sum(n) FROM mass) / n AS rate FROM mass),
steps AS (SELECT source, greatest(1, ceil(rate / {_STEP}))::BIGINT AS steps, rate / greatest(1, ceil(rate / {_STEP})) AS rate FROM rates),
terms AS (SELECT source, k, exp(-rate) * CASE WHEN k = 0 THEN 1 ELSE exp(k * ln(rate) - lgamma(k + 1)) END AS p FROM steps, range(0, 140) AS t(k)),
tables AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM terms),
draws AS (
  SELECT d.doc_id, d.source, s.step, {unit.format(f"'{seed}|' || coalesce(d.doc_id::VARCHAR, '') || '|' || s.step")} AS u
  FROM (SELECT DISTINCT doc_id, source FROM {documents}) d JOIN (SELECT source, unnest(range(1, steps + 1)) AS step FROM steps) s USING (source)),
times AS (
  SELECT d.doc_id, d.source, sum((SELECT count(*) FROM tables t WHERE t.source = d.source AND t.upto <= d.u)) AS n
  FROM draws d GROUP BY d.doc_id, d.source),
copies AS (
  SELECT d.*, unnest(range(1, coalesce(t.n, 1)::BIGINT + 1))::INTEGER AS copy
  FROM {documents} d LEFT JOIN times t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.source IS NOT DISTINCT FROM t.source)
SELECT *, {unit.format(f"'{seed + 1}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy")} AS shuffle_key FROM copies
"""
