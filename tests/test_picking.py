"""Features under points against the rule written out, with ties, holes of rings and points without a place."""

import math

import numpy as np
import pytest

from gridspark.operators import picking


def under(point, features):
    x, y = point
    if x is None or y is None:
        return None, False
    for f, ring in features:
        inside = False
        for (a, b), (c, d) in zip(ring, ring[-1:] + ring[:-1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                inside = not inside
        if inside:
            return f, True
    best = None, 15.0
    for f, ring in features:
        far = math.hypot(x - sum(p[0] for p in ring) / len(ring), y - sum(p[1] for p in ring) / len(ring))
        if far < best[1]:
            best = f, far
    return best[0], False


@pytest.mark.parametrize("cell", [3, 64])
def test_equals_the_rule(spark, cell):
    rng = np.random.default_rng(12)
    features = {0: [(0, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), (1, [(5, 5), (15, 5), (15, 15), (5, 15)]), (2, [(40, 0), (60, 20), (40, 20), (60, 0)]), (3, [(70, 0), (70, 10)])], 1: []}
    for f in range(4, 30):
        at, n = rng.integers(-80, 80, 2), int(rng.integers(3, 9))
        features[1].append((f, [tuple(map(float, p)) for p in (at + rng.integers(-25, 25, (n, 2)) / 2).tolist()]))
    points = [(k, int(k % 2), float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-100, 100, (600, 2)) / 2)]
    points += [(900 + k, 0, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (10, 10), (5, 5), (10, 5), (50, 10), (70, 5), (77.5, 5), (0, 15), (-10, 5)])] + [(999, 0, None, 1.0), (998, None, 1.0, 1.0), (997, 5, 1.0, 1.0)]
    rings = [(s, f, k, *map(float, p)) for s, fs in features.items() for f, ring in fs for k, p in enumerate(ring)]
    got = picking.object_at_point(spark.createDataFrame(points, "point_id long, scene_id long, x double, y double"), spark.createDataFrame(rings, "scene_id long, feature long, seq int, x double, y double"), cell=cell)
    got = {r.point_id: (r.feature, r.inside) for r in got.collect()}
    assert got == {k: under((x, y), features.get(s, [])) for k, s, x, y in points}
    assert sum(i for _, i in got.values()) > 20 and sum(f is not None and not i for f, i in got.values()) > 50


def test_copies_make_no_more_pairs(spark):
    """Equal rings and equal points give the rows that each gives alone, and only the first of equal rings is ever the answer."""
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rings = spark.createDataFrame([(s, f, k, float(x + 100 * (f % 2)), float(y)) for s in (0, 1) for f in range(s * 50, s * 50 + 40) for k, (x, y) in enumerate(ring)], "scene_id long, feature long, seq int, x double, y double")
    points = spark.createDataFrame([(i, i % 2, x, 5.0) for i, x in enumerate([5.0, 5.0, 105.0, 105.0, 15.0, 15.0, 300.0] * 20)], "point_id long, scene_id long, x double, y double")
    made = picking.object_at_point(points, rings)
    first = {5.0: (0, True), 105.0: (1, True), 15.0: (0, False), 300.0: (None, False)}
    want = {i: ((f + s * 50) if f is not None else None, inside) for i, s, x, (f, inside) in ((p.point_id, p.scene_id, p.x, first[p.x]) for p in points.collect())}
    assert {r.point_id: (r.feature, r.inside) for r in made.collect()} == want
    assert made._jdf.queryExecution().optimizedPlan().toString().count("shape") > 0
