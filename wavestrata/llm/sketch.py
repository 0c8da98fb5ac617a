"""Count-min sketches: filled sparse by partition, merged by block on the executors, sent back as one bit a cell."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavestrata.llm.runs import run_starts
from wavestrata.llm.textkit import U64, mix, tidy

_SALT = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
_BLOCK_BITS = 22  # cells of a block, as a power of two
_HELD = 3_000_000  # entries that a task holds before it sends them
_MERGED = 1 << 26  # entries that one task merges, about


@dataclass(frozen=True)
class Rows:
    """depth rows of 2**bits cells from the flat cell `start` on; a cell is flagged from a count of `least` on."""

    depth: int
    bits: int
    least: int = 2
    start: int = 0
    seed: int = 0

    @property
    def end(self) -> int:
        return self.start + (self.depth << self.bits)

    def cells(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """The flat cell of each hash in one row after the other."""
        for d in range(self.depth):
            yield (mix(h ^ U64(_SALT[d + self.seed])) >> U64(64 - self.bits)).astype(np.uint32) + np.uint32(self.start + (d << self.bits))


def bits_for(expected: float, most: int) -> int:
    """The power of two from twice the expected number of distinct hashes on, at most `most`."""
    return max(10, min(most, math.ceil(math.log2(max(1.0, 2 * expected)))))


def _encoded(at: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rising places as differences of one byte (255 goes on), which counts exceed one, and those counts."""
    step = np.diff(at, prepend=np.uint32(0)).astype(np.int64)
    more = step // 255
    out = np.full(int(more.sum()) + len(at), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes(), np.packbits(count > 1).tobytes(), count[count > 1].astype("<u4").tobytes()


def _decoded(places: bytes, many: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    step = np.frombuffer(places, np.uint8)
    at = np.cumsum(step, dtype=np.int64)[step != 255]
    count = np.ones(len(at), np.int64)
    count[np.unpackbits(np.frombuffer(many, np.uint8), count=len(at)).astype(bool)] = np.frombuffer(counts, "<u4")
    return at, count


_PARTS = "block long, salt long, places binary, many binary, counts binary"


def _sparse(at: np.ndarray, count: np.ndarray, salt: int) -> pa.RecordBatch:
    block = at >> np.uint32(_BLOCK_BITS)
    starts = run_starts([block])
    bounds = [*starts.tolist(), len(at)]
    parts = [_encoded(at[s:e] & np.uint32((1 << _BLOCK_BITS) - 1), count[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]
    columns = [pa.array(block[starts].astype(np.int64)), pa.array(np.full(len(parts), salt)), *(pa.array([p[k] for p in parts], pa.binary()) for k in range(3))]
    return pa.RecordBatch.from_arrays(columns, ["block", "salt", "places", "many", "counts"])


def flagged_cells(df: DataFrame, hashes: Callable[[pa.RecordBatch], list[np.ndarray]], rows: list[Rows], expected: float) -> np.ndarray:
    """One bit for each cell of all rows: whether its count reaches what the rows ask for.

    hashes gives one array of hashes for each of rows. A task fills its sketch sparse, as the sorted cells with their counts, and sends
    it by block. Blocks are summed on the executors, in a tree of levels if `expected` entries are more than one task a block
    should read. The driver gets one bit a cell.
    """
    salts = max(1, math.ceil(expected / (_MERGED * ((rows[-1].end >> _BLOCK_BITS) + 1))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts
        held, n = [], 0
        for batch in batches:
            for r, h in zip(rows, hashes(batch), strict=True):
                held += r.cells(h)
                n += len(h) * r.depth
            if n > _HELD:
                yield _sparse(*np.unique(np.concatenate(held), return_counts=True), salt)
                held, n = [], 0
        if n:
            yield _sparse(*np.unique(np.concatenate(held), return_counts=True), salt)

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 << _BLOCK_BITS, np.uint32)
        for batch in batches:
            for parts in zip(*(batch.column(c).to_pylist() for c in ("places", "many", "counts")), strict=True):
                at, count = _decoded(*parts)
                out[at] = np.minimum(out[at] + count, (1 << 32) - 1)
        return out

    def level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = summed(batches)
        at = np.flatnonzero(out)
        yield _sparse((at + (key[0].as_py() << _BLOCK_BITS)).astype(np.uint32), out[at], key[1].as_py() // 64)

    def flags(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = summed(batches), key[0].as_py() << _BLOCK_BITS
        least = np.full(len(out), 1 << 31, np.uint32)
        for r in rows:
            least[max(0, r.start - first) : max(0, r.end - first)] = r.least
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(out >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    parts = df.mapInArrow(tidy(partial), _PARTS)
    while salts > 1:
        parts = parts.groupBy("block", "salt").applyInArrow(level, _PARTS)
        salts = -(-salts // 64)
    size = (1 << _BLOCK_BITS) // 8
    out = np.zeros(-(-rows[-1].end >> _BLOCK_BITS) * size, np.uint8)
    for row in parts.groupBy("block").applyInArrow(flags, "block long, bits binary").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out[: -(-rows[-1].end // 8)].copy()


def flagged(bits: np.ndarray, rows: Rows, h: np.ndarray) -> np.ndarray:
    """For each hash whether all its cells are flagged."""
    out = np.ones(len(h), bool)
    for at in rows.cells(h):
        out &= (bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return out


def byte_total(df: DataFrame, column: str = "text") -> int:
    return int(df.select(F.sum(F.octet_length(column)).alias("n")).first().n or 0)
