"""Padded tiles against numpy, and what their plan may hold."""

import numpy as np
import pytest

from gridspark.operators import imaging


@pytest.mark.parametrize("to_height, to_width", [(7, 9), (4, 20), (3, 5)])
def test_pad_tile(spark, to_height, to_width):
    """Each pixel makes its own copies: no table of places is joined, which a driver would have to hold to broadcast it."""
    a = np.arange(20.0).reshape(4, 5)
    px = spark.createDataFrame([(s, r, c, float(a[r, c]) + s) for s in (1, 2) for r in range(4) for c in range(5)] + [(1, 4, 0, 99.0), (1, -1, 0, 99.0)], "scene_id long, row int, col int, z double")
    made = imaging.pad_tile(px, 4, 5, to_height, to_width)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    index = lambda n, to: [min(i, n - 1) if to - n >= n else i if i < n else 2 * (n - 1) - i for i in range(to)]
    want = a[np.ix_(index(4, to_height), index(5, to_width))]
    got = {(r.scene_id, r.row, r.col): (r.z, r.padded) for r in made.collect()}
    assert got == {(s, r, c): (float(want[r, c]) + s, r >= 4 or c >= 5) for s in (1, 2) for r in range(to_height) for c in range(to_width)}
