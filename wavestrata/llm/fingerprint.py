"""Document fingerprints: quartile bucket digests and their likeness.

The bytes of a text are hashed in triplets (three per place: bytes 0 1 2, 0 1 3 and 0 2 3 of a
four-byte window) into 256 buckets. The digest holds, in hex: the length of the text on a logarithmic
scale (2 digits), the ratios of the first and second to the third quartile of the bucket counts
(1 digit each), and for each bucket in which quarter its count lies (2 bits). It depends on the
bytes alone, so equal texts have equal digests. The difference of two digests is bounded and the
likeness is 1 for equal and 0 for as different as unrelated digests are.

Rows: a null text is empty; an empty text has the digest of no triplets. Neighbours go by falling
doc_id, null last, and by a hash of the text among equal ids; after the last comes the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestrata.llm.store import partitions, small_batches, written
from wavestrata.llm.textkit import row_groups, text_buffers

BUCKETS = 256
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_STEP = np.arange(256, dtype=np.uint32)
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_COST = np.array([0, 1, 2, 6])
_UNRELATED, _SIZE_COST, _RATIO_COST = 416, 24, 12


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out = np.zeros(n * BUCKETS, np.int64)
    for k, (a, b, c) in enumerate(_TRIPLETS):
        m = len(data) - c
        if m <= 0:
            continue
        h = np.full(m, (k + 1) * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for at, factor in zip((a, b, c), _FACTORS, strict=True):
            h += (_STEP * np.uint32(factor))[data[at : at + m]]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = left[:m] > c
        out += np.bincount((row[:m] + (h >> np.uint32(24)))[inside], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 67 bytes for each text: length code, two ratios, 64 bytes of 2-bit quarters."""
    out = np.zeros((len(offsets) - 1, 67), np.uint8)
    for a, b in row_groups(offsets, 2 << 20):
        count = _counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        q = np.partition(count, (63, 127, 191), axis=1)[:, [63, 127, 191]]
        code = (count > q[:, :1]).astype(np.uint8) + (count > q[:, 1:2]) + (count > q[:, 2:])
        size = np.diff(offsets[a : b + 1])
        out[a:b, 0] = np.minimum(255, np.round(np.log1p(size) / np.log(1.1)))
        out[a:b, 1:3] = q[:, :2] * 15 // np.maximum(1, q[:, 2:])
        c = code.reshape(-1, 64, 4)
        out[a:b, 3:] = c[:, :, 0] << 6 | c[:, :, 1] << 4 | c[:, :, 2] << 2 | c[:, :, 3]
    return out


def as_text(digest: np.ndarray) -> str:
    return f"{digest[0]:02x}{digest[1]:x}{digest[2]:x}{digest[3:].tobytes().hex()}"


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[:2], 16), int(text[2], 16), int(text[3], 16), *bytes.fromhex(text[4:])], np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 - difference / bound for each pair of rows of digests, from 0 to 1."""
    def codes(d: np.ndarray) -> np.ndarray:
        return np.stack([d[:, 3:] >> s & 3 for s in (6, 4, 2, 0)], -1).reshape(len(d), -1).astype(np.int64)

    a, b = codes(x), codes(y)
    body = _COST[np.abs(a - b)].sum(1)
    head = np.abs(x[:, :3].astype(np.int64) - y[:, :3])
    other = np.minimum(2 * head[:, 0], _SIZE_COST) + np.minimum(head[:, 1] + head[:, 2], _RATIO_COST)
    bound = np.minimum(_UNRELATED, _COST[3] * ((a > 0).sum(1) + (b > 0).sum(1))) + _SIZE_COST + _RATIO_COST
    return 1 - np.minimum(1, (body + other) / bound)


def _fields(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The result rows of texts and those that follow them."""
    edited = []
    for text, after in zip(texts, following, strict=True):
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + after[:cut])
    own, new, then = (digests(*text_buffers(pa.array(x, pa.large_string()))) for x in (texts, edited, following))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array([as_text(x) for x in own], pa.string()),
        pa.array([as_text(x) for x in new], pa.string()),
        pa.array(likeness(own, new), pa.float64()),
        pa.array(likeness(own, then), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Digest of every text and of its edited text, and their likeness to each other and to the next one's.

    The edited text has its last third replaced by the first characters of the next text. One range
    exchange brings neighbours together; the last row of a partition and the first one of the next
    meet in a second, small step.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    sorted_texts = texts.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def edge(kind: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            row = [pa.array([x], t) for x, t in ((kind, pa.string()), (part, pa.int32()), (text, pa.string()), (doc_id, pa.int64()))]
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*row, *none], ["kind", "part", "edge_text", *_NAMES])

        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(rows), 500):
                i, t = ids[a : a + 500], rows[a : a + 500]
                if last is None:
                    yield edge("first", i[0], t[0])
                else:
                    i, t = [last[0], *i], [last[1], *t]
                last = i[-1], t[-1]
                if len(t) > 1:
                    out = _fields(i[:-1], t[:-1], t[1:])
                    n = out.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), *out.columns], ["kind", "part", "edge_text", *_NAMES])
        if last is not None:
            yield edge("last", *last)

    found = written(sorted_texts.mapInArrow(inside, f"kind string, part int, edge_text string, {_RESULT}"), "fingerprints")
    parts = sorted(r.part for r in found.where("kind = 'first'").select("part").collect())  # one number a partition
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    firsts = found.where("kind = 'first'").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
    pairs = found.where("kind = 'last'").join(follows, "part").join(firsts, "next").select("doc_id", "edge_text", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _fields(*(c.to_pylist() for c in batch.columns))

    return found.where("kind = 'row'").select(*_NAMES).unionByName(pairs.mapInArrow(across, _RESULT))


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
