"""Vectorised work on the words of whole texts, shared by the Arrow-batch operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 this
equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points. Words and word
n-grams are represented by 64-bit hashes of all their bytes. Two different n-grams share a hash
with probability about 2**-64, whatever their words look like; the operators that use the hashes name this.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
_LONG = 64  # bytes from which a word is hashed by a digest of its bytes
_START, _FACTOR = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # the first k of eight bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row the range of its words (n + 1 bounds)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(data) + 1, bool)
    gap = _SEPARATOR[data]
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first = edge[:-1].copy()
    first[inner] = True
    first &= ~gap
    last = np.empty(len(data), bool)
    last[:-1] = gap[1:]
    last[-1] = True
    last[inner - 1] = True
    last &= ~gap
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, A-Z count as a-z.

    The length and then every eight bytes go through a bijection of 64 bits, so different words of one length up to eight bytes never
    agree; words over _LONG bytes are hashed by BLAKE2b.
    """
    data = _LOWER[data] if lower else data
    size, eight = ends - starts, lanes(data)
    h = mix(size.astype(U64) * _START)
    h = mix(h ^ (eight[starts] & _KEEP[np.minimum(size, 8)]))
    more, k = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        h[more] = mix(h[more] * _FACTOR ^ (eight[starts[more] + k] & _KEEP[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_words(x: np.ndarray, x_starts: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_starts: np.ndarray, y_ends: np.ndarray) -> np.ndarray:
    """Whether each word of x has the same bytes as the word of y in its place."""
    size = x_ends - x_starts
    same = size == y_ends - y_starts
    a = lanes(x)
    b = a if x is y else lanes(y)
    rest, k = np.flatnonzero(same & (size <= _LONG)), 0
    while len(rest):
        differ = ((a[x_starts[rest] + k] ^ b[y_starts[rest] + k]) & _KEEP[np.minimum(size[rest] - k, 8)]) != 0
        same[rest[differ]] = False
        k += 8
        rest = rest[~differ & (size[rest] > k)]
    for i in np.flatnonzero(same & (size > _LONG)).tolist():
        same[i] = np.array_equal(x[x_starts[i] : x_ends[i]], y[y_starts[i] : y_ends[i]])
    return same


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i that has n words after it, as if all were one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    acc = words[:m].copy()
    for k in range(1, n):
        acc *= _FACTOR
        acc += words[k : k + m]
    return mix(acc)


def short_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence shorter than an n-gram; its length keeps it apart from n-grams."""
    acc = 0x51ED270B7A9F3C21 ^ len(words)
    for w in words.tolist():
        acc = (acc * 0xD6E8FEB86659FD93 + w) & _MASK
    return int(mix(np.array([acc], U64))[0])


def row_groups(offsets: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows that together have at most so many bytes, or one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its lower-cased word n-grams.

    With fewer words than n, the whole sequence is the one n-gram; without words, there is none.
    """
    data, offsets = text_buffers(column)
    for a, b in row_groups(offsets, 2 << 20):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = word_spans(part, off)
        words = hash_words(part, starts, ends, lower=True)
        grams = ngram_hashes(words, n)
        for k in range(b - a):
            x, y = rows[k], rows[k + 1]
            if y - x >= n:
                yield np.unique(grams[x : y - n + 1])
            elif y > x:
                yield np.array([short_hash(words[x:y])], U64)
            else:
                yield np.zeros(0, U64)


def release_memory() -> None:
    """Give memory that earlier tasks of this Python worker have freed back to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on the batches of a task, giving back freed memory before and after; Python workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
