"""Upper levels and planes of objects against plain Python on whole scenes."""

import collections
import random
import statistics

import numpy as np
import pytest

from gridspark.operators import components, levels, planar


def regions(cells):
    """Components over four neighbours, by first cell."""
    left, out = set(cells), {}
    while left:
        first = min(left)
        todo, got = [first], {first}
        left.discard(first)
        while todo:
            r, c = todo.pop()
            for at in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if at in left:
                    left.discard(at)
                    got.add(at)
                    todo.append(at)
        out[first] = got
    return out


def plain_levels(cells, z, base, height, gap, share, least):
    v = {p: z[p] - base for p in cells if np.isfinite(z[p])}
    vals = np.array(list(v.values()))
    if len(vals) < 30 or vals.max() - vals.min() < gap:
        return []
    lo, hi = vals.min(), vals.max()
    a, b = lo + 0.25 * (hi - lo), lo + 0.75 * (hi - lo)
    for _ in range(24):
        low = abs(vals - a) <= abs(vals - b)
        if low.all() or not low.any():
            return []
        na, nb = vals[low].mean(), vals[~low].mean()
        if abs(na - a) < 1e-3 and abs(nb - b) < 1e-3:
            break
        a, b = na, nb
    if b - a < gap or (~low).mean() < share:
        return []
    up = {p for p, x in v.items() if x > 0.5 * (a + b)}
    if len(up) < least:
        return []
    out = []
    for size, first, part in sorted(((len(p), f, p) for f, p in regions(up).items()), reverse=True)[:2]:
        if size < least:
            continue
        core = {(r, c) for r, c in part if {(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)} <= part} if size > 12 else part
        top = statistics.median(v[p] for p in (core or part))
        if top > height + 0.5 * gap:
            out.append((*first, round(top, 6), size))
    return out


@pytest.fixture(scope="module")
def scene():
    """A scene of 40 x 60 with complex objects: flat ones, ones with one or two raised parts, noise, and values missing."""
    rnd = random.Random(5)
    z, mask = {}, set()
    for r in range(40):
        for c in range(60):
            z[r, c] = rnd.gauss(0, 0.2)
    for i in range(4):
        for j in range(3):
            box = [(r, c) for r in range(j * 13, j * 13 + 11) for c in range(i * 15, i * 15 + 13)]
            mask |= set(box)
            for r, c in box:
                raised = (i > 0 and c - i * 15 < 3 + j) + (i > 1 and c - i * 15 > 9 and r % 13 < 6 + j)
                z[r, c] = 4 + rnd.gauss(0, 0.3) + 3.5 * raised + (rnd.random() < 0.05) * 2
    for p in rnd.sample(sorted(mask), 30):
        z[p] = float("nan")
    return z, mask


@pytest.mark.parametrize("chunk", [8, 64])
def test_levels(spark, scene, chunk):
    z, mask = scene
    found = regions(mask)
    px = spark.createDataFrame([(1, r, c, v) for (r, c), v in z.items()], "scene_id long, row int, col int, z double")
    labels = components.label_components(spark.createDataFrame([(1, r, c) for r, c in mask], "scene_id long, row int, col int"), 4, chunk)
    objects = spark.createDataFrame([(1, r, c, 0.1, 4.0) for r, c in found], "scene_id long, label_row int, label_col int, base double, height double")
    made, pixels = levels.object_levels(labels, px, objects, least=8, chunk=chunk)
    got = sorted((r.label_row, r.label_col, r.part_row, r.part_col, round(r.level_height, 6), r.pixel_count) for r in made.collect())
    want = sorted((*first, *x) for first, cells in found.items() for x in plain_levels(cells, z, 0.1, 4.0, 2.0, 0.15, 8))
    assert got == want
    assert {x[0:2] for x in got} and len(got) >= 8
    n = collections.Counter((r.label_row, r.label_col, r.part_row, r.part_col) for r in pixels.collect())
    assert n == {x[:4]: x[5] for x in got}


def plain_means(vals, gap):
    """Size of the upper cluster and both centres by numpy, or nothing."""
    lo, hi = vals.min(), vals.max()
    if len(vals) < 30 or hi - lo < gap:
        return None
    a, b, n_up = lo + 0.25 * (hi - lo), lo + 0.75 * (hi - lo), 0
    for _ in range(24):
        low = abs(vals - a) <= abs(vals - b)
        if low.all() or not low.any():
            return None
        n_up, na, nb = int((~low).sum()), vals[low].mean(), vals[~low].mean()
        if abs(na - a) < 1e-3 and abs(nb - b) < 1e-3:
            break
        a, b = na, nb
    return n_up, round(a, 6), round(b, 6)


@pytest.mark.parametrize("bound", [1 << 16, 200, 0])
def test_two_means(spark, monkeypatch, bound):
    """Small and large objects have the same clusters, and only large ones take a Spark job a round."""
    rnd = np.random.default_rng(8)
    kinds = [rnd.normal(0, 1, 400), np.concatenate((rnd.normal(0, 1, 150), rnd.normal(9, 2, 40))), np.full(50, 3.0), rnd.normal(0, 5, 29), np.array([0.0] * 29 + [2.0]), rnd.random(300) ** 4 * 50, np.array([0.0, 1.0, 2.0] * 20), rnd.random(90)]
    rel = spark.createDataFrame([(i % 2, i, 3, float(v)) for i, vals in enumerate(kinds) for v in vals] + [(5, 5, 5, None)] * 40, "scene_id long, label_row int, label_col int, rel double")
    cuts, cut = [], levels.cut
    monkeypatch.setattr(levels, "cut", lambda df: cuts.append(1) or cut(df))
    got = {(r.scene_id, r.label_row, r.label_col): (r.n, r.n_up, round(r.c_lo, 6), round(r.c_hi, 6)) for r in levels.two_means(rel, 2.0, bound=bound).collect()}
    want = {(i % 2, i, 3): (len(vals), *found) for i, vals in enumerate(kinds) if (found := plain_means(vals, 2.0))}
    assert got == want and len(got) == 5
    assert (len(cuts) <= 2) == (bound > 400)


def plain_plane(x, y, z, rounds=4):
    a = np.stack([x, y, np.ones_like(x)], 1)
    w = np.ones(len(z))
    fit = lambda: np.linalg.lstsq(a * w[:, None], z * w, rcond=None)[0]
    k = fit()
    for _ in range(rounds):
        r = z - a @ k
        s = max(1.4826 * np.median(abs(r - np.median(r))) + 1e-6, 1e-3)
        w = 1 / np.maximum(abs(r) / (1.345 * s), 1)
        k = fit()
    return a @ k


def test_planes(spark):
    """Planted planes with outliers are found; one line of pixels, noise and small objects have their defined results."""
    rnd = np.random.default_rng(2)
    px, mask, kinds = {}, set(), {}
    for i, (h, w) in enumerate([(20, 25), (12, 12), (1, 40), (20, 20), (3, 3), (15, 30)]):
        cells = [(r + 25 * (i // 3), c + 45 * (i % 3)) for r in range(h) for c in range(w)]
        kinds[cells[0]] = cells
        mask |= set(cells)
        for r, c in cells:
            px[r, c] = 3 + 0.2 * c - 0.1 * r + rnd.normal(0, 0.1) + 8 * (rnd.random() < 0.2) if i != 3 else rnd.normal(0, 9)
    bad = sorted(mask)[7]
    px[bad] = float("nan")
    frame = spark.createDataFrame([(1, r, c, float(v)) for (r, c), v in px.items()], "scene_id long, row int, col int, z double")
    labels = components.label_components(spark.createDataFrame([(1, r, c) for r, c in mask], "scene_id long, row int, col int"), 4, 16)
    out, verdict = planar.planar_refine(frame, labels, least=20)
    got = {(r.row, r.col): r.z for r in out.collect()}
    told = {(r.label_row, r.label_col): r for r in verdict.collect()}
    assert len(got) == len(px) and len(told) == 6
    status = []
    for first, cells in kinds.items():
        cells = [p for p in cells if p != bad]
        x, y, z = (np.array(v, float) for v in ([c for _, c in cells], [r for r, _ in cells], [px[p] for p in cells]))
        plane = plain_plane(x, y, z)
        near = abs(z - plane) <= 1
        t = told[first]
        status.append(t.status)
        assert t.area == len(cells)
        if t.status != "too_small":
            assert t.inliers == near.sum() and t.rmse == pytest.approx(np.sqrt(np.mean((z - plane)[near] ** 2)), abs=1e-6)
            assert (t.status == "accepted") == (near.mean() >= 0.6)
        for p, v, f, ok in zip(cells, z, plane, near):
            assert got[p] == pytest.approx(f if ok and t.status == "accepted" else v, abs=1e-6)
    assert status == ["accepted", "accepted", "accepted", "rejected_inliers", "too_small", "accepted"]
    assert np.isnan(got[bad])
