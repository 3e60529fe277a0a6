"""Nearest seeds against a search over all seeds."""

import numpy as np
import pytest

from gridspark.operators import distance


@pytest.mark.parametrize("share", [0.002, 0.05, 0.6])
def test_nearest_seed_equals_all_seeds(spark, share):
    rng = np.random.default_rng(int(share * 1000))
    shapes, rows, want = {0: (31, 17), 2: (5, 60), 3: (1, 1), 4: (8, 8)}, [], {}
    for s, shape in shapes.items():
        seed, hot = rng.random(shape) < share, rng.random(shape) < 0.7
        if s == 4:
            seed[:] = False  # a scene without a seed gives no row
        rows += [(s, r, c, bool(hot[r, c]) or None, bool(seed[r, c]) or None) for r, c in np.ndindex(*shape)]
        places = [tuple(map(int, p)) for p in np.argwhere(seed)]
        for r, c in map(tuple, np.argwhere(hot).tolist()):
            if places:
                d2, y, x = min(((r - y) ** 2 + (c - x) ** 2, y, x) for y, x in places)
                want[s, r, c] = (y, x, d2)
    px = spark.createDataFrame(rows, "scene_id long, row int, col int, hot boolean, seed boolean").repartition(5)
    got = distance.nearest_seed(px).collect()
    assert len(got) == len(want) and {(r.scene_id, r.row, r.col): (r.seed_row, r.seed_col, r.d2) for r in got} == want
