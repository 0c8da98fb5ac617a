"""Substring dedup: remove word windows that occurred earlier, with a count-min prefilter.

1. Each partition counts, in a count-min sketch, every window (one row of cells) and, in two more rows, the windows'
   minimizers (the leftmost smallest hash among a window's inner word 8-grams, counted once per place). Equal windows at
   different starts have equal minimizers at different places, so each row of the merged sketch overestimates the count of every window,
   and a window whose least estimate is 1 is unique. The number of cells follows from the bytes of the input.
2. A second pass looks at windows estimated repeated only. Each batch settles what repeats
   inside it; the first of each window goes to an exact grouping by minimizer (64 bits) and
   window hash (48 bits), windows of one minimizer in one row. So a passage in a third of all
   documents sends a few rows per batch. Windows of a minimizer that a further row of cells estimates frequent, as in
   near copies of one text, are grouped by minimizer and window together, so they spread over all tasks.
3. The marks meet the texts again by document, and the words they cover go.

The sketch goes to all executors, so `most_bits` bounds its rows (by default 2**28 cells for windows and 2**26 for each row of
minimizers, 48 MB of bits in all, reached at about a gigabyte of text). Beyond that more unique windows reach step 2; results do not change.
Two different windows are taken for the same with probability 2**-64 in a batch, 2**-112 between batches.

Rows: a null text is empty; empty texts and texts with fewer words than a window lose
nothing; a null doc_id comes after all others; of rows with the same doc_id and start none is
earlier than the other, so equal rows get equal results. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestrata.llm.runs import whole_runs
from wavestrata.llm.sketch import Rows, bits_for, byte_total, flagged, flagged_cells
from wavestrata.llm.store import partitions, small_batches, written
from wavestrata.llm.textkit import U64, as_long, hash_words, mix, row_groups, text_buffers, tidy, word_spans

_LAST = np.iinfo(np.int64).max
_OFTEN = 200  # places of a minimizer from which its windows are dealt out one by one
_BYTES = 6  # of a window's hash, beside the 8 of its minimizer's


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def _spans_hashes(words: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all runs of each size, built from runs of powers of two."""
    have, k = {1: words}, 1
    while 2 * k <= max(sizes):
        x = have[k]
        have[2 * k] = _joined(x[: max(0, len(x) - k)], x[k:]) if len(x) > k else np.zeros(0, U64)
        k *= 2
    out = {}
    for n in sizes:
        m, acc, at = max(0, len(words) - n + 1), None, 0
        for k in sorted(have, reverse=True):
            if n & k:
                part = have[k][at : at + m]
                acc, at = part if acc is None else _joined(acc, part), at + k
        out[n] = acc[:m]
    return out


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each full run of width values, the index of the first smallest one."""
    value, index, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        value, index = np.where(right, value[step:], value[:-step]), np.where(right, index[step:], index[:-step])
        have += step
    return index


class _Windows:
    """The windows of a few rows: their hashes, rows, starts and minimizers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        starts, ends, bounds = word_spans(data, offsets)
        self.row = self.start = np.zeros(0, np.int64)
        self.least = self.hash = np.zeros(0, U64)
        self.place = np.zeros(0, np.int64)
        if len(starts) < window:
            return
        words = hash_words(data, starts, ends)
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(np.arange(len(words)) + window <= bounds[1:][owner])
        if not len(at):
            return
        runs = _spans_hashes(words, (gram, window))
        place = _leftmost_least(runs[gram], window - gram + 1)[at]
        self.place, self.least = place, runs[gram][place]
        self.hash, self.row = runs[window][at], owner[at]
        self.start = at - bounds[:-1][self.row]


def _counted(window: int, gram: int):  # noqa: ANN202
    """What the sketch counts of a batch: its windows, its minimizers, and these again for the row that finds frequent ones."""

    def hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
        data, offsets = text_buffers(batch.column(0))
        whole, least = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for a, b in row_groups(offsets, 1 << 20):
            w = _Windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram)
            whole.append(w.hash)
            least.append(w.least[np.flatnonzero(np.diff(w.place, prepend=-1))])  # places never go back
        minimizers = np.concatenate(least)
        return [np.concatenate(whole), minimizers, minimizers]

    return hashes


def sketch_rows(n_bytes: int, window: int, gram: int, most_bits: int) -> tuple[list[Rows], float]:
    """The rows of cells for so many bytes of text, and how many entries they get: windows, minimizers, frequent minimizers."""
    words = n_bytes / 7
    places = words * 2 / (window - gram + 2)
    seen = Rows(1, bits_for(words, most_bits))
    least = Rows(2, bits_for(places, most_bits - 2), start=seen.end, seed=1)
    bits = bits_for(places / 32, most_bits - 4)
    often = Rows(1, bits, least=max(_OFTEN, int(16 * places / (1 << bits))), start=least.end, seed=3)
    return [seen, least, often], words + 3 * places


_RUNS = "least long, doc_id long, text_key long, start int, n int, hashes binary"


def _runs(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, place: np.ndarray, least: np.ndarray | None, h: np.ndarray) -> pa.RecordBatch:
    """Windows of one minimizer that follow each other as one row; without least, all that follow each other."""
    order = np.lexsort((start, row))
    row, start, place, h = row[order], start[order], place[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    if least is not None:
        new[1:] |= place[1:] != place[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(row)))
    if least is None:
        keys, hashes = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary())
    else:
        raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()
        bounds = np.append(first, len(row)).astype(np.int32) * _BYTES
        keys, hashes = pa.array(as_long(least[order][first])), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    at = pa.array(row[first])
    return pa.RecordBatch.from_arrays([keys, batch.column(0).take(at), batch.column(1).take(at), pa.array(start[first], pa.int32()), pa.array(size, pa.int32()), hashes], ["least", "doc_id", "text_key", "start", "n", "hashes"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by minimizer, the windows that another run has earlier, as (doc_id, text_key, start, n)."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table["doc_id"].combine_chunks()
        size = table["n"].to_numpy()
        run = np.repeat(np.arange(len(size)), size)
        start = table["start"].to_numpy().astype(np.int64)[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        raw = np.zeros((len(run), 8), np.uint8)
        raw[:, :_BYTES] = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint8).reshape(-1, _BYTES)
        h, group, doc = raw.view("<u8")[:, 0], table["least"].to_numpy()[run], ids.fill_null(_LAST).to_numpy(zero_copy_only=False)[run]
        order = np.lexsort((start, doc, h, group))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        found = order[(doc[order] != doc[first]) | (start[order] != start[first])]
        if len(found):
            found.sort()  # by run, then start
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1] + 1
            new[1:] |= run[found][1:] != run[found][:-1]
            head = np.flatnonzero(new)
            at = pa.array(run[found[head]])
            yield pa.RecordBatch.from_arrays([ids.take(at), table["text_key"].combine_chunks().take(at), pa.array(start[found[head]], pa.int32()), pa.array(np.diff(np.append(head, len(found))), pa.int32())], ["doc_id", "text_key", "start", "n"])

    for table in whole_runs(batches, 1):
        yield from settle(table)


def repeated_windows(docs: DataFrame, window: int = 20, gram: int = 8, most_bits: int = 28) -> DataFrame:
    """(doc_id, text_key, runs): where, in words, windows that also start earlier begin, as (start, n)."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    rows, entries = sketch_rows(byte_total(texts), window, gram, most_bits)
    shared = spark.sparkContext.broadcast(flagged_cells(texts.select("text"), _counted(window, gram), rows, entries))
    seen, least_seen, frequent = rows

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(2))
            found = []
            for a, b in row_groups(offsets, 1 << 20):
                w = _Windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram)
                if len(w.hash):
                    keep = np.flatnonzero(flagged(sketch, seen, w.hash))
                    keep = keep[flagged(sketch, least_seen, w.least[keep])]
                    h, place, least = w.hash[keep], w.place[keep], w.least[keep]
                    often = flagged(sketch, frequent, least)
                    place[often] = -1 - w.start[keep][often]  # a run of its own
                    least = np.where(often, _joined(least, h), least)
                    found.append((h, w.row[keep] + a, w.start[keep], place, least))
            if not found:
                continue
            h, row, start, place, least = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            order = np.lexsort((start, ids[row], h))
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = (ids[row[order]] != ids[row[first]]) | (start[order] != start[first])
            for x, known in ((order[again], True), (order[~again], False)):
                if len(x):
                    yield _runs(batch, row[x], start[x], place[x], None if known else least[x], h[x])

    keyed = texts.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    found = written(keyed.mapInArrow(tidy(settle), _RUNS), "windows")
    own = found.where("least IS NULL").select("doc_id", "text_key", "start", "n")
    first = found.where("least IS NOT NULL").repartition(partitions(spark), "least").sortWithinPartitions("least")
    marks = own.unionByName(first.mapInArrow(tidy(_later), "doc_id long, text_key long, start int, n int"))
    return marks.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def dedup_substrings(docs: DataFrame, window: int = 20, **sketch: int) -> DataFrame:
    """docs with the words of later windows removed from text.

    A text that loses nothing stays as it is; of others the kept words are joined by one space.
    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space), which replace
    input columns of these names; all other columns stay.
    """
    added = ("n_words", "n_removed", "kept_sha256")
    small_batches(docs.sparkSession)
    docs = docs.drop(*added)
    marks = repeated_windows(docs, window, **sketch).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("runs").alias("__runs"))
    keyed = docs.withColumns({"__own": F.col("doc_id").cast("long"), "__text_key": F.xxhash64("text")})
    both = keyed.join(marks, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
    both = both.select(*docs.columns, "__runs")
    names = docs.columns
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            starts, ends, bounds = word_spans(data, offsets)
            marked = batch.column(batch.num_columns - 1).to_pylist()
            texts, total, removed, digests = batch.column(place).to_pylist(), np.diff(bounds), [], []
            for k, marks in enumerate(marked):
                s, e = starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]]
                keep = np.ones(len(s), bool)
                if marks:
                    change = np.zeros(len(s) + 1, np.int64)
                    for r in marks:
                        change[r["start"]] += 1
                        change[r["start"] + r["n"] - 1 + window] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                kept = b" ".join([data[x:y].tobytes() for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
                n = int(len(s) - keep.sum())
                removed.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                if n:
                    texts[k] = kept.decode()
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], [*names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return both.mapInArrow(tidy(cut), schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS k, w FROM words WHERE len(w) >= 20),
hashed AS (SELECT doc_id, k, array_to_string(w[k : k + 19], ' ') AS g FROM windows),
later AS (SELECT doc_id, k FROM hashed QUALIFY (doc_id, k) > min((doc_id, k)) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM later, range(0, 20) AS t(d)),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM words),
kept AS (
  SELECT e.doc_id, count(g.k) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.k) FILTER (g.k IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
