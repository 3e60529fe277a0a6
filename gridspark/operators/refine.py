"""Smoothing of heights by an image: edge weights and the joint bilateral filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gridspark.operators.halo import CHUNK, with_halo
from gridspark.operators.wls import edge_weight

COLOURS = ["red", "green", "blue"]


def edge_weights(px: DataFrame, sigma: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, row, col, right, down)``: how alike a pixel of ``px(scene_id, row, col, z, red, green, blue)`` is to its neighbours to the right and below, 0 to 1; 0 at the border and where either z is not finite."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rgb, ok = np.stack([x[c] for c in COLOURS], -1), np.isfinite(x["z"])
        right, down = np.zeros(ok.shape), np.zeros(ok.shape)
        right[:, :-1] = np.where(ok[:, :-1] & ok[:, 1:], edge_weight(rgb[:, :-1], rgb[:, 1:], sigma), 0)
        down[:-1] = np.where(ok[:-1] & ok[1:], edge_weight(rgb[:-1], rgb[1:], sigma), 0)
        return {"right": right, "down": down}

    return with_halo(px, ["z", *COLOURS], 1, kernel, ["right", "down"], chunk)


def joint_bilateral(px: DataFrame, radius: int = 5, sigma_color: float = 0.1, sigma_space: float = 3.0, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, row, col, q)``: the mean of z over a square window, weighed by distance and by the sum of colour differences; z that is not finite counts nowhere and stays NaN."""

    def kernel(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rgb, ok = np.stack([x[c] for c in COLOURS], -1) / 255.0, np.isfinite(x["z"])
        p, m = np.where(ok, x["z"], 0.0), ok.astype(float)
        h, w = p.shape
        total, weights = np.zeros((h, w)), np.zeros((h, w))
        for a in range(-min(radius, h - 1), min(radius, h - 1) + 1):
            for b in range(-min(radius, w - 1), min(radius, w - 1) + 1):
                here = slice(max(0, -a), h - max(0, a)), slice(max(0, -b), w - max(0, b))
                there = slice(max(0, a), h + min(0, a)), slice(max(0, b), w + min(0, b))
                far = np.abs(rgb[here] - rgb[there]).sum(-1)
                weight = np.exp(-(far**2) / (2 * max(sigma_color, 1e-6) ** 2) - (a * a + b * b) / (2 * max(sigma_space, 1e-6) ** 2)) * m[there]
                total[here] += weight * p[there]
                weights[here] += weight
        q = np.divide(total, weights, out=np.zeros((h, w)), where=weights > 1e-12)
        return {"q": np.where(ok, q, np.nan)}

    return with_halo(px, ["z", *COLOURS], radius, kernel, ["q"], chunk)
