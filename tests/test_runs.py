"""Whole groups out of sorted batches, and labels of many chunks at once."""

import numpy as np
import pyarrow as pa
import pytest

from gridspark.functions.runs import whole_groups
from gridspark.operators import components


@pytest.mark.parametrize("rows", [1, 7, 40, 10_000])
def test_no_group_is_cut(rows):
    rng = np.random.default_rng(rows)
    sizes = rng.integers(1, 30, 50)
    a = np.repeat(np.arange(50) // 3, sizes)
    b = np.repeat(np.arange(50) % 3, sizes)
    table = pa.table({"a": a, "b": b, "v": np.arange(len(a))})
    seen, groups = [], 0
    for part, first in whole_groups(iter(table.to_batches(max_chunksize=11)), ["a", "b"], rows):
        keys = list(zip(part["a"].to_pylist(), part["b"].to_pylist()))
        assert [keys[k] for k in first] == list(dict.fromkeys(keys))
        seen += part["v"].to_pylist()
        groups += len(first)
    assert seen == list(range(len(a))) and groups == 50
    assert list(whole_groups(iter([]), ["a"])) == []


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_at_once(conn):
    """Chunks do not meet, whatever lies at their rims; a spiral is one component."""
    rng = np.random.default_rng(conn)
    masks = rng.random((20, 9, 9)) < rng.random((20, 1, 1))
    masks[3], masks[4] = True, False
    masks[5] = [[int(c) for c in line] for line in ("111111111", "000000001", "111111101", "100000101", "101110101", "101000101", "101111101", "100000001", "111111111")]
    at, row, col = np.nonzero(masks)
    place = components._labels_at_once(at, row, col, 9, conn)
    for k, mask in enumerate(masks):
        own = at == k
        want = components._local_labels(mask, conn)[row[own], col[own]]
        assert (at[place[own]] == k).all() and (row[place[own]] * 9 + col[place[own]] == want).all()


def test_copies_of_pixels_are_labelled_once(spark):
    rows = [(1, r, c) for r in range(6) for c in range(6) if (r + c) % 3]
    got = components.label_components(spark.createDataFrame(rows * 3, "scene_id long, row int, col int"), 4, 4).collect()
    assert sorted((r["scene_id"], r["row"], r["col"]) for r in got) == rows
