"""Quality classifier: kernel ridge on document statistics by random Fourier features, calibrated.

Every whole text becomes the statistics named in FEATURES (lang, source, doc_id and labels are never among
them). They are standardised over all documents; cosines of fixed random projections then approximate a
Gaussian kernel. Each partition sums its part of the normal equations, once for each of two folds of the
labelled rows; the executors add the parts up and the driver solves two fold models and the model of both. Each
fold is scored by the other's model, these scores are counted in fixed bins, and pool-adjacent-violators on
the bins gives a monotone map from the model's value to the share of label 1, linear between the centres of the pools. Texts
are described once: the statistics are a table, from which the fit and the scores are computed.

The driver holds one matrix of RANDOM + 1 columns a fold and BINS counts, whatever the input. All labelled rows
take part in the fit.

Rows: a null text is empty; an empty text has all statistics 0 and gets a score like any other. Labels of one
doc_id are averaged and count as 1 from 0.5 on; null labels and labels of unknown documents are ignored. Without
labels to learn from every score is 0.5; with one class only, it is that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestrata.llm.store import dropped, partitions, small_batches, written
from wavestrata.llm.textkit import hash_words, ngram_hashes, row_groups, text_buffers, tidy, word_spans

RANDOM, SEED, RIDGE, BINS, BLOCK = 256, 11, 1e-3, 2000, 32
LOW, HIGH = -0.5, 1.5
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "bang": b"!", "bar": b"|", "stop": b".?", "comma": b",;:", "quote": b"'\"()-",
    "symbol": b"#$%&*@^~<>{}[]_=+\\/`", "gap": b" ", "break": b"\n\r", "other": range(128, 256),
}
FEATURES = (
    *(f"{c} share" for c in _CLASSES), "log bytes", "log words", "byte entropy", "mean word length", "word length deviation", "longest word",
    "distinct words", "distinct pairs", "equal neighbours", "short words", "symbol words", "capital words", "bar words",
    "most equal neighbours", "most symbol words", "most capital words", "most bar words", "least distinct words", "words a line",
)


def _most(values: np.ndarray, starts: np.ndarray, rows: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """For each row the largest share over its blocks of words."""
    out = np.zeros(n)
    if len(starts):
        np.maximum.at(out, rows, np.add.reduceat(values.astype(np.float64), starts) / size)
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)), np.float32)
    for a, b in row_groups(offsets, 1 << 20):
        out[a:b] = _statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    count = np.bincount(np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256)
    total = np.maximum(1, size)
    share = count / total[:, None]
    columns = [share[:, list(c)].sum(1) for c in _CLASSES.values()]
    starts, ends, bounds = word_spans(data, offsets)
    words = np.diff(bounds)
    each = np.maximum(1, words)
    row = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(np.float64)
    within = lambda chars: (lambda t: t[ends] - t[starts])(np.concatenate([[0], np.cumsum(np.isin(np.arange(256), list(chars))[data])]))
    per_row = lambda x: np.bincount(row, x, minlength=n) / each
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    mean = per_row(length)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    h = hash_words(data, starts, ends)
    pair = ngram_hashes(h, 2)
    inside = row[1:] == row[:-1]
    equal = np.zeros(len(h), bool)
    equal[1:] = inside & (h[1:] == h[:-1])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    p_row, p = row[:-1][inside], pair[inside]
    p_order = np.lexsort((p, p_row))
    p_fresh = np.ones(len(p), bool)
    p_fresh[1:] = (p[p_order][1:] != p[p_order][:-1]) | (p_row[p_order][1:] != p_row[p_order][:-1])
    symbol, capital = within(_CLASSES["symbol"]) > 0, (within(_CLASSES["upper"]) >= 0.6 * length) & (length > 1)
    bar = (within(b"|") > 0) & (length == 1)
    new_in_text = np.zeros(len(h), bool)
    new_in_text[order[fresh]] = True  # lexsort is stable, so this is the word's first place
    place = np.arange(len(h)) - bounds[:-1][row]
    block = np.flatnonzero(place % BLOCK == 0)
    in_block = np.diff(np.append(block, len(h)))
    full = np.maximum(in_block, BLOCK // 2)
    most = lambda x: _most(x, block, row[block], n, full)
    lines = count[:, 10] + 1
    columns += [
        np.log1p(size), np.log1p(words), entropy, mean, np.sqrt(np.maximum(0, per_row(length**2) - mean**2)), np.log1p(longest),
        np.bincount(row[order][fresh], minlength=n) / each, np.bincount(p_row[p_order][p_fresh], minlength=n) / np.maximum(1, words - 1),
        per_row(equal), per_row(length <= 3), per_row(symbol), per_row(capital), per_row(bar),
        most(equal), most(symbol), most(capital), most(bar), most(~new_in_text), np.log1p(words / lines),
    ]
    out = np.stack(columns, 1)
    out[size == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """mean and scale of the statistics, weights of the random features, and the calibration's corners."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(random_features(x, self.mean, self.scale) @ self.weights, self.at, self.value)


def random_features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    projection, shift = rng.normal(0, 1 / np.sqrt(d), (d, RANDOM)), rng.uniform(0, 2 * np.pi, RANDOM)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.cos(z @ projection + shift) * np.sqrt(2 / RANDOM), np.ones((len(x), 1))], 1)


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _moments(features: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    d = len(FEATURES)
    exprs = [f(F.col("x")[k].cast("double")).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.avg, F.stddev_pop)]
    got = list(features.agg(*exprs).first())
    clean = [0.0 if v is None else v for v in got]
    return np.array(clean[::2]), np.maximum(1e-6, np.array(clean[1::2]))


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the pools of the non-decreasing sequence nearest to value, by pooling neighbours that do not rise."""
    pools: list[tuple[float, float, float]] = []
    for x, v, w in zip(at.tolist(), value.tolist(), weight.tolist(), strict=True):
        pools.append((x, v, w))
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            (x1, v1, w1), (x2, v2, w2) = pools[-2:]
            w = w1 + w2
            pools[-2:] = [((x1 * w1 + x2 * w2) / w, (v1 * w1 + v2 * w2) / w, w)]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


def fit(features: DataFrame, labelled: DataFrame) -> Model:
    """features: (x); labelled: (x, y, fold) with fold 0 or 1."""
    mean, scale = _moments(features)
    width = RANDOM + 1
    labelled = labelled.coalesce(max(1, partitions(features.sparkSession) // 8))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, width + 1))
        for batch in batches:
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = random_features(_rows(batch.column(0)), mean, scale)
            for k in (0, 1):
                zk = z[fold == k]
                sums[k] += np.concatenate([zk.T @ zk, (zk.T @ y[fold == k])[:, None]], 1)
        rows = [sums[k, i].tobytes() for k in (0, 1) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width)), pa.array(rows, pa.binary())], ["row", "part"])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width + 1)
        for batch in batches:
            for raw in batch.column("part").to_pylist():
                out += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["row", "part"])

    sums = np.zeros((2 * width, width + 1))
    for r in labelled.select("x", "y", "fold").mapInArrow(partial, "row long, part binary").groupBy("row").applyInArrow(total, "row long, part binary").collect():
        sums[r.row] = np.frombuffer(r.part)
    folds = sums.reshape(2, width, width + 1)

    def solve(s: np.ndarray) -> np.ndarray:
        n = s[-1, width - 1]
        penalty = np.full(width, RIDGE * max(1.0, n))
        penalty[-1] = 1e-9
        return np.linalg.solve(s[:, :width] + np.diag(penalty), s[:, width]) if n else np.zeros(width)

    both = folds.sum(0)
    n, ones = both[-1, width - 1], both[-1, width]
    if n == 0 or ones in (0, n):
        value = 0.5 if n == 0 else ones / n
        return Model(mean, scale, solve(both), np.array([0.0, 1.0]), np.array([value, value]))
    own = [solve(s) for s in folds]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BINS, 2))
        for batch in batches:
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = random_features(_rows(batch.column(0)), mean, scale)
            raw = np.where(fold == 0, z @ own[1], z @ own[0])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            np.add.at(out, at, np.stack([np.ones(len(y)), y], 1))
        used = np.flatnonzero(out[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used, 0]), pa.array(out[used, 1])], ["bin", "n", "ones"])

    bins = labelled.select("x", "y", "fold").mapInArrow(counted, "bin long, n double, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    table = np.array(sorted((r.bin, r.n, r.ones) for r in bins.collect()))  # BINS rows at most
    at = LOW + (table[:, 0] + 0.5) * (HIGH - LOW) / BINS
    return Model(mean, scale, solve(both), *isotonic(at, table[:, 2] / table[:, 1], table[:, 1]))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs, and __x, the statistics of text, as a table."""
    small_batches(docs.sparkSession)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            bounds = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.ravel()))], [*keep, "__x"])

    given = docs.select(F.col("text").alias("__text"), *keep)
    schema = T.StructType([*given.schema.fields[1:], T.StructField("__x", T.ArrayType(T.FloatType()))])
    return written(given.mapInArrow(tidy(describe), schema), "statistics")


def learn(features: DataFrame, labels: DataFrame) -> Model:
    """The model for a table with doc_id and __x."""
    features = features.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__x").alias("x"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("y"))
    known = known.where(~held_out(F.col("id"))).select("id", F.when(F.col("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    fold = F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0, 0).otherwise(1).cast("long")
    labelled = written(features.join(known, F.col("doc_id") == F.col("id")).select("x", "y", fold.alias("fold")), "labelled")
    model = fit(features, labelled)
    dropped(labelled)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with held_out, score (0 to 1) and predicted (1 from 0.5 on), which replace such columns.

    labels has doc_id and quality. Rows that held_out marks are not learned from.
    """
    added = ("held_out", "score", "predicted")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    table = described(docs, [*keep, *({"doc_id"} - set(keep))])
    model = learn(table, labels)

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_rows(x)))

    scored = table.select(*keep, held_out(F.col("doc_id")).alias("held_out"), score("__x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, labels, ["doc_id"])
