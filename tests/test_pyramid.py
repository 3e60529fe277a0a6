"""Levels of tiles against plain loops on whole scenes of several sizes."""

import math

import numpy as np
import pytest

from gridspark.operators.pyramid import pyramid


def edges(k, extent, z):
    lo, hi = round(k * extent / 2**z), round((k + 1) * extent / 2**z)
    return lo, hi, max(hi, lo + 1)


def overlap(a, b, c, d):
    return max(0.0, min(b, d) - max(a, c))


def plain(a, deepest, size):
    """Sums of value and of weight of each cell; a level's cells share out those of the level below by area."""
    pieces = [(r, r + 1, c, c + 1, float(a[r, c]) if np.isfinite(a[r, c]) else 0.0, float(np.isfinite(a[r, c])), None) for r in range(a.shape[0]) for c in range(a.shape[1])]
    out = {}
    for z in range(deepest, -1, -1):
        made = {}
        for y in range(2**z):
            for x in range(2**z):
                y0, _, y1 = edges(y, a.shape[0], z)
                x0, _, x1 = edges(x, a.shape[1], z)
                if y0 >= a.shape[0] or x0 >= a.shape[1]:
                    for i in range(size):
                        for j in range(size):
                            out[z, y, x, i, j] = None
                    continue
                own = [p for p in pieces if p[6] is None or p[6] == (y, x)]
                for i in range(size):
                    for j in range(size):
                        r0, r1 = y0 + i * (y1 - y0) / size, y0 + (i + 1) * (y1 - y0) / size
                        c0, c1 = x0 + j * (x1 - x0) / size, x0 + (j + 1) * (x1 - x0) / size
                        wz = w = 0.0
                        for a0, a1, b0, b1, v, n, _ in own:
                            s = overlap(r0, r1, a0, a1) / (a1 - a0) * overlap(c0, c1, b0, b1) / (b1 - b0)
                            wz, w = wz + v * s, w + n * s
                        made[y, x, i, j] = (r0, r1, c0, c1, wz, w)
                        out[z, y, x, i, j] = wz / w if w > 1e-9 else None
        pieces = []
        for (y, x, i, j), p in made.items():
            keep = True
            for k, extent in ((y, a.shape[0]), (x, a.shape[1])):
                lo, hi, _ = edges(k, extent, z)
                if lo == hi and z:
                    up = edges(k // 2, extent, z - 1)
                    keep &= up[0] == up[1] and k % 2 == 0
            if keep:
                pieces.append((*p, (y // 2, x // 2)))
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_pyramid(spark, size):
    rng = np.random.default_rng(4)
    shapes = {1: (7, 12), 2: (5, 3), 3: (1, 1), 4: (9, 9)}
    deepest, rows, want = 3, [], {}
    for s, shape in shapes.items():
        a = rng.normal(size=shape) * 10
        a[rng.random(shape) < 0.15] = np.nan
        if s == 3:
            a[:] = 5.0
        if s == 4:
            a[:5, :5] = np.inf
        rows += [(s, r, c, float(a[r, c])) for r in range(shape[0]) for c in range(shape[1])]
        fine = a[np.isfinite(a)]
        for key, h in plain(a, deepest, size).items():
            flat = fine.max() - fine.min() < 1e-6
            want[s, *key] = (h, 32768 if h is None or flat else round(min(max((h - fine.min()) / (fine.max() - fine.min()), 0), 1) * 65535))
    px = spark.createDataFrame(rows, "scene_id long, row int, col int, z double")
    scenes = spark.createDataFrame([(s, h, w) for s, (h, w) in shapes.items()], "scene_id long, height int, width int")
    got = {(r.scene_id, r.z, r.y, r.x, r.i, r.j): (r.height, r.code) for r in pyramid(px, scenes, deepest, size).collect()}
    assert got.keys() == want.keys()
    for key, (h, code) in want.items():
        assert (h is None) == (got[key][0] is None) and (h is None or math.isclose(h, got[key][0], abs_tol=1e-9)), key
        assert abs(code - got[key][1]) <= (0 if h is None else 1e-6)
    assert pyramid(px.limit(0), scenes.limit(0), 1, size).count() == 0
