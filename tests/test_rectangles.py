"""Rectangles of objects against a search over all rectangles and all directions between pixels."""

import itertools
import math

import numpy as np
import pytest

from gridspark.operators.rectangles import largest_rectangle, rect_decompose


def plain_largest(mask):
    found = []
    for y0, x0 in itertools.product(*map(range, mask.shape)):
        for y1, x1 in itertools.product(range(y0 + 1, mask.shape[0] + 1), range(x0 + 1, mask.shape[1] + 1)):
            if mask[y0:y1, x0:x1].all():
                found.append((-(y1 - y0) * (x1 - x0), y1, x1, y0 - y1, (x0, y0, x1, y1)))
    return min(found)[-1] if found else None


def filled(mask):
    out, todo = np.pad(mask, 1), [(0, 0)]
    seen = {(0, 0)}
    while todo:
        r, c = todo.pop()
        for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= p[0] < out.shape[0] and 0 <= p[1] < out.shape[1] and p not in seen and not out[p]:
                seen.add(p)
                todo.append(p)
    return np.array([[(r + 1, c + 1) not in seen for c in range(mask.shape[1])] for r in range(mask.shape[0])])


def plain(cells):
    """``cells``: (x, y) of an object's pixels."""
    rect = []
    for (ax, ay), (bx, by) in itertools.combinations(cells, 2):
        d = math.hypot(bx - ax, by - ay)
        c, s = (bx - ax) / d, (by - ay) / d
        spans = [max(p) - min(p) for p in ([x * c + y * s for x, y in cells], [y * c - x * s for x, y in cells])]
        for (c1, s1), more in (((c, s), spans[0] - spans[1]), ((-s, c), spans[1] - spans[0])):
            if c1 < -1e-12 or (abs(c1) <= 1e-12 and s1 < 0):
                c1, s1 = -c1, -s1
            if more > 1e-9 or (more >= -1e-9 and abs(s1) <= abs(c1)):
                rect.append((round(spans[0] * spans[1], 6), round(math.atan2(s1, c1), 9), c1, s1, max(spans), min(spans)))
    if not rect or min(rect)[0] == 0:
        return []
    _, _, c, s, long, wide = min(rect)
    turned = [(x * c + y * s, y * c - x * s) for x, y in cells]
    u0, v0 = min(u for u, _ in turned) - 2, min(v for _, v in turned) - 2
    frame = np.zeros((math.ceil(wide - 1e-9) + 4, math.ceil(long - 1e-9) + 4), bool)
    for u, v in turned:
        for a, b in itertools.product((-0.5, 0.5), repeat=2):
            frame[math.floor(v - v0 + a + 1e-9), math.floor(u - u0 + b + 1e-9)] = True
    left = filled(frame)
    total, out = left.sum(), []
    for _ in range(4):
        got = plain_largest(left)
        if got is None or (got[2] - got[0]) * (got[3] - got[1]) < 0.08 * total:
            break
        x0, y0, x1, y1 = got
        left[y0 : y1 + 1, x0 : x1 + 1] = False
        if x1 - x0 > 1 and y1 - y0 > 1:
            out.append([((x + u0) * c - (y + v0) * s, (x + u0) * s + (y + v0) * c) for x, y in ((x0 + 0.5, y0 + 0.5), (x1 - 0.5, y0 + 0.5), (x1 - 0.5, y1 - 0.5), (x0 + 0.5, y1 - 0.5))])
    return out if len(out) > 1 else []


def test_largest_rectangle():
    rng = np.random.default_rng(1)
    for k in range(150):
        mask = rng.random((int(rng.integers(1, 7)), int(rng.integers(1, 8)))) < rng.choice([0.5, 0.7, 0.9, 1.0, 0.0])
        assert largest_rectangle(mask) == plain_largest(mask), k


def shape(test, n=14):
    return [(x, y) for x in range(n) for y in range(n) if test(x, y)]


def test_rect_decompose(spark):
    t = math.radians(25)
    turn = lambda x, y: ((x - 6) * math.cos(t) + (y - 6) * math.sin(t), (y - 6) * math.cos(t) - (x - 6) * math.sin(t))
    ell = lambda u, v: -6 <= u <= 6 and -5 <= v <= 5 and (u < -1 or v > 1)
    rng = np.random.default_rng(2)
    objects = {
        1: shape(lambda x, y: x < 5 or y > 8), 2: shape(lambda x, y: ell(*turn(x, y))), 3: shape(lambda x, y: x < 8 and y < 5), 4: [(3, 3)], 5: [(x, 2) for x in range(6)],
        6: shape(lambda x, y: 3 < x < 8 or 5 < y < 10), 7: shape(lambda x, y: (x - 6) ** 2 + (y - 6) ** 2 < 30), 8: shape(lambda x, y: x in (0, 1, 9, 10) and y < 11 or y in (0, 1, 9, 10) and x < 11),
        9: [p for p in shape(lambda x, y: x < 9 and y < 9) if rng.random() < 0.8],
    }
    rows = [(1, k, 1000, y + 10 * k, x + 1000) for k, cells in objects.items() for x, y in cells] + [(1, 1, 1000, 10, 1000), (1, 1, 1000, None, 1000)]
    df = spark.createDataFrame(rows, "scene_id long, label_row int, label_col int, row int, col int").repartition(3)
    got = {}
    for r in rect_decompose(df).collect():
        got.setdefault(r.label_row, {})[r.part, r.seq] = (r.x - 1000, r.y - 10 * r.label_row)
    for k, cells in objects.items():
        want = {(i, j): p for i, part in enumerate(plain(cells)) for j, p in enumerate(part)}
        assert got.get(k, {}).keys() == want.keys(), k
        for key, p in want.items():
            assert got[k][key] == pytest.approx(p, abs=1e-6), (k, key)
    assert {1, 2, 6} <= got.keys() and not {3, 4, 5} & got.keys()
    assert rect_decompose(df, bound=20).count() == 0 and rect_decompose(df.limit(0)).count() == 0
