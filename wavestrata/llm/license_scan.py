"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies.

Templates are grouped by size. For a group whose largest template has B words, a text is cut into blocks of B
words and a window is two neighbouring blocks, so every passage of up to B words lies within a window. The
words are lower-cased and lose what is not a letter or digit at their ends; shingles have five of them (a template with
fewer is one shingle of its own length).

Each of a group's hash functions gives every window its least shingle hash; `rows` neighbouring functions form a
band, and windows that agree with a template in a band are candidates for it. A window holding the threshold's
share of a template has at least the similarity c = threshold * s / (s + w) to it, s and w being the shingles of the smallest
template in the group and of a window; the number of bands is the least with (1 - c ** rows) ** bands <= MISS,
so a match is missed with at most that probability (independent hashes supposed). Candidates are then
verified by the exact share of the template's shingles in the window.

Templates are a parameter and travel with the tasks; documents are scanned whole where they lie, without any shuffle.

Rows: a null text is empty; texts without words match nothing; repeated rows get equal results; one row a document and
template matched, from the window with the greatest share (the first of equals). Other columns of the documents, whatever
their names, play no part. An empty table, or no templates, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavestrata.llm.store import small_batches
from wavestrata.llm.textkit import U64, hash_words, mix, ngram_hashes, row_groups, text_buffers, word_spans

SHINGLE, THRESHOLD, ROWS, MISS = 5, 0.8, 1, 1e-5

# License notices as they are commonly worded.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def _core_byte() -> np.ndarray:
    core = np.zeros(256, bool)
    core[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return core


_CORE = _core_byte()


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that have a letter or digit, and the n + 1 bounds of the rows."""
    starts, ends, bounds = word_spans(data, offsets)
    core = np.flatnonzero(_CORE[data])
    left, right = np.searchsorted(core, starts), np.searchsorted(core, ends)
    keep = right > left
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    h = hash_words(data, core[left[keep]], core[right[keep] - 1] + 1, lower=True)
    return h, np.searchsorted(row, np.arange(len(bounds)))


@dataclass
class Group:
    """Templates of like size: their shingles, the block size and the bands."""

    block: int
    shingle: int
    names: list[str]
    sets: list[np.ndarray]
    bands: int
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each band: which first 16 bits its keys have, the sorted keys, their templates

    @property
    def salts(self) -> np.ndarray:
        """A factor for each hash function; shingle hashes are mixed already."""
        return mix(np.arange(1, self.bands * ROWS + 1).astype(U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def bands_for(shared: float) -> int:
    """Bands that miss a window of this similarity with a probability of MISS at most."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - shared**ROWS))) if shared < 1 else 1


def _band_keys(shingles: np.ndarray, salts: np.ndarray, least: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """The keys of each band, from the least values of its hash functions."""
    for k in range(0, len(salts), ROWS):
        key = least(shingles * salts[k])
        for salt in salts[k + 1 : k + ROWS]:
            key = mix(key + least(shingles * salt))
        yield key


def template_groups(templates: dict[str, str], threshold: float = THRESHOLD) -> list[Group]:
    """Templates of one shingle size whose word counts lie within a factor of two share a group."""
    sized: dict[tuple[int, int], list[tuple[str, int, np.ndarray]]] = {}
    for name, text in templates.items():
        h, _ = words_of(*text_buffers(pa.array([text])))
        if len(h):
            n = min(SHINGLE, len(h))
            sized.setdefault((n, int(math.log2(len(h)))), []).append((name, len(h), np.unique(ngram_hashes(h, n))))
    groups = []
    for (n, _), members in sorted(sized.items()):
        block, least = max(m[1] for m in members), min(len(m[2]) for m in members)
        found = max(1, math.ceil(threshold * least))
        group = Group(block, n, [m[0] for m in members], [m[2] for m in members], bands_for(found / (2 * block - n + 1 + least - found)), [])
        place = np.concatenate([[0], np.cumsum([len(m[2]) for m in members])[:-1]])
        for key in _band_keys(np.concatenate(group.sets), group.salts, lambda x, place=place: np.minimum.reduceat(x, place)):
            order = np.argsort(key, kind="stable")
            has = np.zeros(1 << 16, bool)
            has[key >> U64(48)] = True
            group.keys.append((has, key[order], order))
        groups.append(group)
    return groups


def windows_of(bounds: np.ndarray, block: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 shingle of every block with any, its row, and its first word in the row."""
    words = np.diff(bounds)
    n = np.where(words >= shingle, -(-np.maximum(0, words - shingle + 1) // block), 0)
    row = np.repeat(np.arange(len(words)), n)
    word = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * block
    start = bounds[:-1][row] + word
    return start, np.minimum(start + block, bounds[1:][row] - shingle + 1), row, word


def candidates(group: Group, grams: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(window, template) that agree in a band; window k is block k and the next of the same row."""
    joined = np.zeros(len(start), bool)
    joined[:-1] = row[1:] == row[:-1]
    inside = np.zeros(len(grams) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    used = np.flatnonzero(np.cumsum(inside[:-1]) > 0)  # shingles across rows belong to no block
    place = np.searchsorted(used, start)
    out = []

    def least(x: np.ndarray) -> np.ndarray:
        blocks = np.minimum.reduceat(x, place)
        blocks[:-1] = np.where(joined[:-1], np.minimum(blocks[:-1], blocks[1:]), blocks[:-1])
        return blocks

    for (has, keys, owner), key in zip(group.keys, _band_keys(grams[used], group.salts, least), strict=True):
        near = np.flatnonzero(has[key >> U64(48)])
        first, last = np.searchsorted(keys, key[near], "left"), np.searchsorted(keys, key[near], "right")
        for w in np.flatnonzero(last > first).tolist():
            out += [(near[w], owner[x]) for x in range(first[w], last[w])]
    return np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)


def scan(column: pa.Array, groups: list[Group], threshold: float) -> Iterator[tuple[int, str, float, int, int]]:
    """(row, template, share, first word, words) of the best window of each row and template that match."""
    data, offsets = text_buffers(column)
    for a, b in row_groups(offsets, 2 << 20):
        h, bounds = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        for g in groups:
            grams = ngram_hashes(h, g.shingle)
            start, end, row, word = windows_of(bounds, g.block, g.shingle)
            if not len(start):
                continue
            for w, t in candidates(g, grams, start, end, row).tolist():
                last = end[w + 1] if w + 1 < len(row) and row[w + 1] == row[w] else end[w]
                share = len(np.intersect1d(grams[start[w] : last], g.sets[t])) / len(g.sets[t])
                key = int(row[w]) + a, g.names[t]
                if share >= threshold and share > best.get(key, (0.0,))[0]:
                    best[key] = share, int(word[w]), int(last - start[w]) + g.shingle - 1
        yield from ((*k, *v) for k, v in sorted(best.items()))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, template, containment, window_start, window_words): words are counted without those that have no letter or digit."""
    small_batches(docs.sparkSession)
    groups = template_groups(templates, threshold)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(scan(batch.column(1), groups, threshold))
            rows, names, shares, starts, words = zip(*found, strict=True) if found else [()] * 5
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(starts, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "template", "containment", "window_start", "window_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, template string, containment double, window_start long, window_words long")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
