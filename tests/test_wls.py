"""Edge-aware least squares against the dense equations, for several sizes of chunks and scenes of several sizes."""

import numpy as np
import pytest

from gridspark.operators import wls


def dense(z, rgb, conf, lam, sigma):
    h, w = z.shape
    ok = np.isfinite(z)
    n = h * w
    a, b = np.zeros((n, n)), np.zeros(n)
    at = np.arange(n).reshape(h, w)
    for r, c in np.ndindex(h, w):
        if not ok[r, c]:
            a[at[r, c], at[r, c]] += 1
            continue
        a[at[r, c], at[r, c]] += conf[r, c]
        b[at[r, c]] = conf[r, c] * z[r, c]
        for y, x in ((r + 1, c), (r, c + 1)):
            if y < h and x < w and ok[y, x]:
                weight = lam * np.exp(-((np.abs(rgb[r, c] - rgb[y, x]).sum() / 255) ** 2) / sigma**2)
                i, j = at[r, c], at[y, x]
                a[i, i] += weight
                a[j, j] += weight
                a[i, j] -= weight
                a[j, i] -= weight
    out = np.linalg.solve(a, b).reshape(h, w)
    out[~ok] = np.nan
    return out


@pytest.mark.parametrize(("chunk", "lam"), [(8, 1.0), (64, 24.0)])
def test_equals_dense_solution(spark, chunk, lam):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for s, (h, w) in {1: (19, 14), 2: (6, 21)}.items():
        z = rng.normal(size=(h, w)) * 4 + np.add.outer(np.arange(h), np.arange(w)) / 3
        z[rng.random((h, w)) < 0.08] = np.nan
        rgb = rng.integers(90, 130, (h, w, 3)) + np.where(np.arange(w) > w // 2, 60, 0)[None, :, None]
        conf = rng.random((h, w)) + 0.05
        want[s] = dense(z, rgb, np.clip(conf, 0, 1), lam, 0.1)
        rows += [(s, r, c, float(z[r, c]), *map(int, rgb[r, c]), float(conf[r, c])) for r, c in np.ndindex(h, w)]
    px = spark.createDataFrame(rows, "scene_id long, row int, col int, z double, red int, green int, blue int, conf double")
    got = wls.wls_refine(px, lam, 0.1, tol=1e-9, chunk=chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = want[r.scene_id][r["row"], r["col"]]
        assert (r.x is None) == np.isnan(expected) and (r.x is None or abs(r.x - expected) < 1e-5)


def test_ragged_scene(spark):
    """Chunks that begin and end elsewhere than their neighbours, since pixels at their rims are missing, are tied at the right places."""
    rng = np.random.default_rng(4)
    z, rgb, conf = rng.normal(size=(18, 20)) * 3, rng.integers(100, 120, (18, 20, 3)), np.ones((18, 20))
    gone = np.zeros(z.shape, bool)
    gone[:8, :3] = gone[8:16, 14:] = gone[13:, :8] = True
    want = dense(np.where(gone, np.nan, z), rgb, conf, 4.0, 0.3)
    rows = [(1, r, c, float(z[r, c]), *map(int, rgb[r, c])) for r, c in np.ndindex(*z.shape) if not gone[r, c]]
    px = spark.createDataFrame(rows, "scene_id long, row int, col int, z double, red int, green int, blue int")
    got = wls.wls_refine(px, 4.0, 0.3, tol=1e-9, chunk=8).collect()
    assert len(got) == len(rows)
    assert max(abs(r.x - want[r["row"], r["col"]]) for r in got) < 1e-5
