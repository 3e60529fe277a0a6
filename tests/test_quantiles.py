"""Percentiles by narrowing against sorted lists, for several bounds."""

import math
import random

import pytest

from gridspark.operators.quantiles import percentiles

QS = [0.0, 0.02, 0.5, 0.98, 1.0]


def plain(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    a, b = math.floor(at), math.ceil(at)
    return values[a] if a == b else (b - at) * values[a] + (at - a) * values[b]


@pytest.mark.parametrize("bins, bound", [(1024, 1 << 16), (64, 20), (8, 50)])
def test_percentiles(spark, bins, bound):
    rnd = random.Random(3)
    groups = {
        1: [rnd.gauss(0, 5) for _ in range(400)],
        2: [float(rnd.randrange(4)) for _ in range(300)],
        3: [7.25] * 200,
        4: [10.0 ** rnd.uniform(-4, 4) * rnd.choice([-1, 1]) for _ in range(200)],
        5: [1.5],
        6: [-1.7e308, 1.7e308, 0.0, 3.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(1, float("nan")), (1, None), (2, float("inf")), (7, float("nan"))]
    rnd.shuffle(rows)
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", QS, bins, bound).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for p, q in zip(got[k].p, QS):
            assert p == pytest.approx(plain(vs, q), rel=1e-12)


def test_empty(spark):
    assert percentiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", QS).count() == 0


@pytest.mark.parametrize("bound", [1 << 16, 1])
def test_last_bit(spark, bound):
    """Between two values the last bit is that of the compiled SQL, a fused multiply-add, so what is quantised by it falls into the same step."""
    pairs = [(186.91 + i * 1.37, 187.36 + i * 2.91) for i in range(60)] + [(-3.3, 7.7), (0.88, 0.88)]
    qs = [0.04, 0.35, 0.98]
    got = percentiles(spark.createDataFrame([(k, v) for k, p in enumerate(pairs) for v in p], "k int, v double"), ["k"], "v", qs, 8, bound).collect()
    assert {r.k: tuple(r.p) for r in got} == {k: tuple(math.fma(a, 1 - q, b * q) for q in qs) for k, (a, b) in enumerate(pairs)}


def test_stretched_units(spark):
    """Filled stretches take these percentiles to the last bit, and what is not valid or flat is 0."""
    from gridspark.operators import pixels

    rnd = random.Random(5)
    values = {s: [round(rnd.uniform(0, 300), 2) for _ in range(rnd.randrange(20, 60))] for s in range(20)}
    rows = [(s, 0, c, v) for s, vs in values.items() for c, v in enumerate(vs)] + [(0, 1, 0, -9999.0), (1, 1, 0, float("nan"))] + [(99, 0, c, 4.5) for c in range(9)]
    made = pixels.stretch_to_01(spark.createDataFrame(rows, "scene_id long, row int, col int, z double"), nodata=-9999.0, flat=0.0, fill=0.0)

    def unit(s, v):
        if s == 99 or not v >= 0:
            return 0.0
        at = lambda q: q * (len(values[s]) - 1)
        own = sorted(values[s])
        lo, hi = (math.fma(own[math.floor(a)], 1 - (a - math.floor(a)), own[math.ceil(a)] * (a - math.floor(a))) for a in (at(0.02), at(0.98)))
        return min(max((v - lo) / (hi - lo), 0.0), 1.0)

    got = {(r.scene_id, r.row, r.col): r.unit for r in made.collect()}
    assert got == {(s, r, c): unit(s, v) for s, r, c, v in rows}
