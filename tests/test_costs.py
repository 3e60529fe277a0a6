"""Nearest cells of targets against a search over all cells."""

import numpy as np

from gridspark.operators import costs


def test_nearest_cells_equal_all_cells(spark):
    rng = np.random.default_rng(8)
    cells = sorted({(int(s), int(r), int(c)) for s, r, c in zip(rng.integers(0, 2, 60), rng.integers(0, 40, 60), rng.integers(0, 70, 60))})
    targets = [(k, int(rng.integers(0, 3)), int(rng.integers(0, 40)), int(rng.integers(0, 70))) for k in range(120)] + [(500, *cells[3]), (501, *cells[3])]
    c = spark.createDataFrame(cells, "scene_id long, row int, col int")
    t = spark.createDataFrame(targets, "point_id long, scene_id long, trow int, tcol int")
    got = {r.point_id: (r.d2, r["row"], r["col"]) for r in costs.nearest_reachable(c, t).collect()}
    near = lambda s, y, x: [((r - y) ** 2 + (q - x) ** 2, r, q) for z, r, q in cells if z == s]
    assert got == {k: min(near(s, y, x)) for k, s, y, x in targets if s < 2}
    for radius in (1, 5, 17):
        got = {r.point_id: (r["row"], r["col"], r.d2) for r in costs.nearest_standable(c, t, radius).collect()}
        for k, s, y, x in targets:
            rings = [(max(abs(r - y), abs(q - x), 1), d2, r, q) for d2, r, q in near(s, y, x) if max(abs(r - y), abs(q - x)) <= radius]
            assert got[k] == (min(rings)[2:] + min(rings)[1:2] if rings else (None, None, None))
