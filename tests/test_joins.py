"""Values at fractional places against plain loops."""

import math
import random

import pytest

from gridspark.operators import joins


def test_resample_sends_a_point_once(spark):
    rnd = random.Random(2)
    z = {(r, c): float("nan") if rnd.random() < 0.2 else rnd.uniform(-9, 9) for r in range(6) for c in range(8) if rnd.random() < 0.9}
    at = [(rnd.uniform(-2, 7), rnd.uniform(-2, 9)) for _ in range(150)] + [(2.0, 3.0), (5.0, 7.0), (-1.0, -1.0)]
    px = spark.createDataFrame([(4, r, c, v) for (r, c), v in z.items()], "scene_id long, row int, col int, z double")
    points = spark.createDataFrame([(i, 4, *p) for i, p in enumerate(at)] + [(900, 5, 1.0, 1.0)], "point_id long, scene_id long, v double, u double")
    made = joins.resample_bilinear(px, points)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # of the pixels; points are not taken apart
    got = {r.point_id: r.z for r in made.collect()}
    assert len(got) == len(at) + 1 and math.isnan(got[900])
    for i, (v, u) in enumerate(at):
        r, c = math.floor(v), math.floor(u)
        taps = [((1 - (v - r)) if a == 0 else v - r, (1 - (u - c)) if b == 0 else u - c, z.get((r + a, c + b), float("nan"))) for a in (0, 1) for b in (0, 1)]
        own = [(p * q, x) for p, q, x in taps if not math.isnan(x)]
        total = sum(w for w, _ in own)
        assert (math.isnan(got[i]) if total <= 0 else got[i] == pytest.approx(sum(w * x for w, x in own) / total, abs=1e-9))
