"""Helpers for tasks that read Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Rows of each key of batches that come sorted by the integer column ``key``; holds one key's rows at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and keys[start] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def small(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in ``column`` take about ``most_bytes``; a longer text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)
