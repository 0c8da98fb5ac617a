"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows again, in tables that hold whole runs of the first so many columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = run_starts([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])[-1]
        if last == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == batch.column(k)[0] for k in range(keys)):
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
