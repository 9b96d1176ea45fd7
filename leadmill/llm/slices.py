"""Arrow batches cut so that a task holds few texts at a time, and sorted rows cut into runs of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices with about ``most`` bytes of a text column and at most ``rows`` rows; one longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        low = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > low and (held + size > most or i - low >= rows):
                yield batch.slice(low, i - low)
                low = i
                held = 0
            held += size
        if low < batch.num_rows:
            yield batch.slice(low)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (longs without nulls), from rows that come in the order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        last = tuple(c[-1] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield pa.Table.from_batches([*held, batch.slice(low, high - low)])
            held = []
        held.append(batch.slice(cuts[-1]))
    if held:
        yield pa.Table.from_batches(held)
