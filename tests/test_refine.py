"""Image-guided kernels do not depend on the size of chunks, and equal plain sums."""

import numpy as np
import pytest

from gridspark.operators import refine
from tests.test_halo import grid, scene


@pytest.mark.parametrize("chunk", [8, 64])
def test_joint_bilateral_equals_plain_sums(spark, chunk):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(13, 18)) * 2 + 5
    z[rng.random(z.shape) < 0.1] = np.nan
    rgb = rng.integers(0, 80, (3, *z.shape)).astype(float)
    want = np.full(z.shape, np.nan)
    for r, c in np.ndindex(*z.shape):
        if np.isfinite(z[r, c]):
            total = weights = 0.0
            for y in range(max(0, r - 2), min(13, r + 3)):
                for x in range(max(0, c - 2), min(18, c + 3)):
                    if np.isfinite(z[y, x]):
                        far = np.abs(rgb[:, r, c] - rgb[:, y, x]).sum() / 255
                        w = np.exp(-(far**2) / (2 * 0.1**2)) * np.exp(-((r - y) ** 2 + (c - x) ** 2) / (2 * 3.0**2))
                        total, weights = total + w * z[y, x], weights + w
            want[r, c] = total / weights
    px = scene(spark, z=z, red=rgb[0], green=rgb[1], blue=rgb[2])
    assert np.allclose(grid(refine.joint_bilateral(px, 2, chunk=chunk), "q", z.shape), want, equal_nan=True)
    right = grid(refine.edge_weights(px, chunk=chunk), "right", z.shape)
    far = np.abs(rgb[:, :, :-1] - rgb[:, :, 1:]).sum(0) / 255
    ok = np.isfinite(z[:, :-1]) & np.isfinite(z[:, 1:])
    assert np.allclose(right[:, :-1], np.where(ok, np.exp(-(far**2) / 0.01), 0)) and not right[:, -1].any()


def test_window_wider_than_the_scene(spark):
    one = scene(spark, z=np.array([[1.0, 3.0]]), red=np.zeros((1, 2)), green=np.zeros((1, 2)), blue=np.zeros((1, 2)))
    w = np.exp(-1 / 18)
    assert np.allclose(grid(refine.joint_bilateral(one, 5), "q", (1, 2)), [[(1 + 3 * w) / (1 + w), (3 + w) / (1 + w)]])
