"""Objects taken apart into rectangles along their own axes, each object in a group of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.components import LABEL, _local_labels

PARTS, LEAST_SHARE, PAD, MAX_CELLS = 4, 0.08, 2, 4_000_000  # fixed values


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in order; only the ends of each row can be corners. Points of one line give none."""
    rows, first = np.unique(y, return_inverse=True)
    left, right = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    np.minimum.at(left, first, x)
    np.maximum.at(right, first, x)

    def chain(points) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    points = sorted({*zip(left, rows.astype(float)), *zip(right, rows.astype(float))})
    corners = chain(points)[:-1] + chain(points[::-1])[:-1]
    return np.array(corners if len(corners) > 2 else []).reshape(-1, 2)


def long_axis(corners: np.ndarray) -> tuple[float, float]:
    """Cosine and sine of the longer side of the smallest rectangle around a hull, pointing right (or up the rows).

    A side lies along an edge of the hull. Of equally small rectangles the one with the least angle counts; of equal sides the flatter one.
    """
    best = None
    for dx, dy in np.roll(corners, -1, 0) - corners:
        c, s = dx / math.hypot(dx, dy), dy / math.hypot(dx, dy)
        along, across = np.ptp(corners @ (c, s)), np.ptp(corners @ (-s, c))
        for (c1, s1), more in (((c, s), along - across), ((-s, c), across - along)):
            if c1 < -1e-12 or (abs(c1) <= 1e-12 and s1 < 0):
                c1, s1 = -c1, -s1
            if more > 1e-9 or (more >= -1e-9 and abs(s1) <= abs(c1)):
                key = (round(along * across, 6), round(math.atan2(s1, c1), 9))
                if best is None or key < best[0]:
                    best = (key, (c1, s1))
    return best[1]


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """``(x0, y0, x1, y1)``, ends exclusive, of the largest rectangle of ones. Of equal ones that which ends in the first row, then furthest left, then the tallest.

    Row by row, each column keeps the height of ones above it and how far that height reaches to both sides.
    """
    width = mask.shape[1]
    at = np.arange(width)
    height, left, right = np.zeros(width, int), np.zeros(width, int), np.full(width, width)
    best, found = 0, None
    for row, ones in enumerate(mask):
        run_left = np.maximum.accumulate(np.where(ones, 0, at + 1))
        run_right = np.minimum.accumulate(np.where(ones, width, at)[::-1])[::-1]
        height = np.where(ones, height + 1, 0)
        left = np.where(ones, np.maximum(left, run_left), 0)
        right = np.where(ones, np.minimum(right, run_right), width)
        area = height * (right - left)
        most = area.max(initial=0)
        if most > best:
            best = most
            k = min(np.flatnonzero(area == most), key=lambda i: (right[i], -height[i]))
            found = (int(left[k]), int(row - height[k] + 1), int(right[k]), row + 1)
    return found


def _without_holes(mask: np.ndarray) -> np.ndarray:
    lab = _local_labels(~np.pad(mask, 1), 4)  # the first cell is outside
    return mask | ((lab != 0) & (lab != lab.size))[1:-1, 1:-1]


def decompose(x: np.ndarray, y: np.ndarray, parts: int = PARTS, least: float = LEAST_SHARE, bound: int = MAX_CELLS) -> list[np.ndarray]:
    """Corners (4 x 2) of the rectangles of one object; see ``rect_decompose``."""
    corners = hull(x, y)
    if not len(corners):
        return []
    c, s = long_axis(corners)
    u, v = x * c + y * s, y * c - x * s
    u0, v0 = u.min() - PAD, v.min() - PAD
    size = (math.ceil(np.ptp(v) - 1e-9) + 2 * PAD, math.ceil(np.ptp(u) - 1e-9) + 2 * PAD)
    if size[0] * size[1] > bound:
        return []
    frame = np.zeros(size, bool)
    for a in (-0.5, 0.5):
        for b in (-0.5, 0.5):
            # sides that fall on a border of cells do so whatever the rounding
            frame[np.floor(v - v0 + a + 1e-9).astype(int), np.floor(u - u0 + b + 1e-9).astype(int)] = True
    left = _without_holes(frame)
    total, out = left.sum(), []
    for _ in range(parts):
        found = largest_rectangle(left)
        if found is None or (found[2] - found[0]) * (found[3] - found[1]) < least * total:
            break
        x0, y0, x1, y1 = found
        p, q = np.array([x0 + 0.5, x1 - 0.5, x1 - 0.5, x0 + 0.5]) + u0, np.array([y0 + 0.5, y0 + 0.5, y1 - 0.5, y1 - 0.5]) + v0
        if x1 - x0 > 1 and y1 - y0 > 1:
            out.append(np.stack([p * c - q * s, p * s + q * c], 1))
        left[y0 : y1 + 1, x0 : x1 + 1] = False
    return out if len(out) > 1 else []


def rect_decompose(labels: DataFrame, parts: int = PARTS, least: float = LEAST_SHARE, bound: int = MAX_CELLS) -> DataFrame:
    """``(*label, part, seq, x, y)``: corners of up to ``parts`` rectangles that make up each object of ``labels(*label, row, col)``.

    The object's pixels, each stamped as a square, are drawn into the frame of the smallest rectangle around them, and holes are filled.
    The largest rectangle in it is taken out, with the cells along its far sides, until one is under ``least`` of the
    frame's pixels; rectangles shrink by half a pixel on each side, as stamps are that much wider. x is along columns. An object on one line, one that
    is a single rectangle, and one whose frame has over ``bound`` cells (a limit of the rule itself, which also bounds a group) give
    no row. Null places are no pixels, repeated ones count once.
    """
    px = labels.select(*LABEL, "row", "col").dropna().distinct()
    small = px.groupBy(*LABEL).agg(F.count("*").alias("n")).where(F.col("n") <= bound).select(*LABEL)

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        # places from the object's first row and column, so corners do not lose digits far from the origin
        row, col = table["row"].to_numpy(), table["col"].to_numpy()
        made = decompose((col - col.min()).astype(float), (row - row.min()).astype(float), parts, least, bound)
        rows = [(*(k.as_py() for k in key), i, j, float(x + col.min()), float(y + row.min())) for i, part in enumerate(made) for j, (x, y) in enumerate(part)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip([*LABEL, "part", "seq", "x", "y"], types))})

    return px.join(small, LABEL).groupBy(*LABEL).applyInArrow(apply, "scene_id long, label_row int, label_col int, part int, seq int, x double, y double")
