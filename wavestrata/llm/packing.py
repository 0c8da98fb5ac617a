"""Best-fit packing of token pieces into sequences by minimum bin slack.

Texts become token ids and texts over the capacity are cut into full pieces and a rest.
How pieces share sequences depends on their lengths alone, so the plan is made from the counts of
the lengths (at most `capacity` numbers). Each step opens a bin with the largest length left,
finds the fullest feasible combination of the lengths left by a bitset subset-sum dynamic program,
and uses this pattern for as many bins as the counts allow. Pieces then take the places of their
length by rank. Ranks are counted within (length, salt), so a length that a third of all pieces have
is dealt to many tasks.

Rows: a null text is empty and becomes the end id alone; every row is a document of its own,
also when doc_id is null or repeats; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavestrata.llm.store import partitions, small_batches, written
from wavestrata.llm.textkit import row_groups, text_buffers, tidy
from wavestrata.llm.tokens import WordTokenizer

CAPACITY = 2048
SALTS = 4096


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text; with keep_ids also the ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of_worker(tokenizer)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in row_groups(offsets, 2 << 20):
                flat, bounds = words.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                n = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                left = bounds[row] + start
                right = np.minimum(left + capacity, bounds[row + 1])
                raw = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(left.tolist(), right.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row + a)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(right - left, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(left, right[-1:]), pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(pieces), schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination with the largest sum up to room; lengths in falling order."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for x in lengths:
        left = min(counts[x], room // x) if x <= room else 0
        part = 1
        while left > 0:
            part = min(part, left)
            grown = reach | (reach << (part * x)) & mask
            if grown != reach:
                steps.append((x, part, reach))
                reach = grown
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for x, part, before in reversed(steps):
        if not before >> total & 1:
            used[x] = used.get(x, 0) + part
            total -= part * x
    return sorted(used.items(), reverse=True)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, pattern) in order: so many bins hold each length of the pattern so many times."""
    left, plan = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(left, reverse=True)
    while lengths:
        largest = lengths[0]
        left[largest] -= 1
        pattern = dict(fullest(lengths, left, capacity - largest))
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        bins = min(left[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            left[x] -= n * bins
        plan.append((bins, sorted(pattern.items(), reverse=True)))
        lengths = [x for x in lengths if left[x]]
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys length << 48 | first rank; per key: first rank, times in a bin, first bin, offset in the bin."""
    rank, rows, base = {}, [], 0
    for bins, pattern in plan:
        offset = 0
        for x, n in pattern:
            first = rank.get(x, 0)
            rows.append((x << 48 | first, first, n, base, offset))
            rank[x] = first + n * bins
            offset += x * n
        base += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table[:, 0], table[:, 1:]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; lengths are 1 to capacity. pieces is read twice."""
    spark = pieces.sparkSession
    salts = min(SALTS, max(8, partitions(spark)))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(_places(packing_plan(counts, capacity)))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__row", own).join(first, ["length", "__salt"])  # partitioned alike already
    ranked = ranked.select(*pieces.columns, (F.col("__first") + F.col("__row") - 1).alias("__rank"))
    at, names = pieces.columns.index("length"), [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at, batch.num_columns - 1))
            first, times, base, offset = table[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            step = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base + step // times), pa.array(offset + step % times * length)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, vocabulary(), CAPACITY)
