"""Outlines against a walk around each component, for several sizes of chunks."""

import collections

import numpy as np
import pytest

from gridspark.operators import components, outlines

STEP = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def walked(cells):
    """Rings of one component as lists of corners ``(x, y)``, by walking its border sides."""
    left = {(r, c, k) for r, c in cells for k in range(4) if (r + STEP[k - 1][0], c + STEP[k - 1][1]) not in cells}
    rings = []
    while left:
        first = at = min(left)
        corners = []
        while at in left:
            left.discard(at)
            r, c, k = at
            a, b = STEP[k]
            p, q = STEP[k - 1]
            if (r + a, c + b) not in cells:
                at = (r, c, (k + 1) % 4)
            elif (r + a + p, c + b + q) not in cells:
                at = (r + a, c + b, k)
            else:
                at = (r + a + p, c + b + q, (k + 3) % 4)
            if at[2] != k:
                corners.append((c + (k in (0, 1)), r + (k in (1, 2))))
        assert at == first
        rings.append(corners[-1:] + corners[:-1] if at[2] != k else corners)  # a hole's first side may begin between corners
    return rings


def shoelace(ring):
    return sum(x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1])) / 2


@pytest.mark.parametrize("chunk", [8, 64])
def test_rings_equal_a_walk(spark, chunk):
    rng = np.random.default_rng(9)
    mask = rng.random((26, 31)) < 0.62
    mask[3:20, 4:24] |= np.add.outer(np.arange(17), np.arange(20)) % 5 > 0
    df = spark.createDataFrame([(2, int(r), int(c)) for r, c in np.argwhere(mask)] + [(5, 0, 0), (5, 1, 1), (5, 1, 2)], "scene_id long, row int, col int")
    labels = components.label_components(df, 4, chunk).cache()
    cells = collections.defaultdict(set)
    for r in labels.collect():
        cells[r.scene_id, r.label_row, r.label_col].add((r["row"], r["col"]))
    got = collections.defaultdict(dict)
    for r in outlines.polygonize(labels, chunk).collect():
        got[r.scene_id, r.label_row, r.label_col].setdefault((r.ring, r.outer), {})[r.seq] = (r.x, r.y)
    assert set(got) == set(cells)
    for label, rings in got.items():
        found = [[ring[k] for k in range(len(ring))] for _, ring in sorted(rings.items(), key=lambda i: i[0][0])]
        assert found == walked(cells[label])
        assert [o for _, o in sorted(rings, key=lambda i: i[0])] == [True] + [False] * (len(rings) - 1)
        assert sum(map(shoelace, found)) == len(cells[label]) and shoelace(found[0]) > 0 and all(shoelace(h) < 0 for h in found[1:])
    assert any(len(r) > 2 for r in got.values())


def test_no_labels(spark):
    empty = spark.createDataFrame([], "scene_id long, row int, col int, label_row int, label_col int")
    assert outlines.polygonize(empty).count() == 0
