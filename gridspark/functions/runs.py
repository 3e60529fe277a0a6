"""Whole groups out of a stream of rows that are sorted by their group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS = 1 << 17


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows (more only if one group has more) that cut no group, and the place of each group's first row.

    ``batches`` are sorted by ``keys``, whole numbers without nulls; what is held is one table and the group that it ends in.
    """
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            first = _first_rows(table, keys)
            held, n = table.slice(first[-1]).to_batches(), n - int(first[-1])
            if first[-1]:
                yield table.slice(0, first[-1]), first[:-1]
    if n:
        table = pa.Table.from_batches(held)
        yield table, _first_rows(table, keys)


def _first_rows(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for key in keys:
        value = table[key].to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(new)
