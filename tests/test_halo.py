"""Halo kernels against plain numpy on the whole scene, for several sizes of chunks."""

import numpy as np
import pytest

from gridspark.operators import components, halo


def scene(spark, **bands):
    shape = next(iter(bands.values())).shape
    rows = [(3, r, c, *(float(b[r, c]) for b in bands.values())) for r in range(shape[0]) for c in range(shape[1])]
    return spark.createDataFrame(rows, "scene_id long, row int, col int, " + ", ".join(f"{b} double" for b in bands))


def grid(df, name, shape):
    out = np.full(shape, np.inf)
    for r in df.collect():
        assert out[r["row"], r["col"]] == np.inf  # every pixel once
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.fixture(scope="module")
def holed():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(29, 37)) * 3 + 10
    z[rng.random(z.shape) < 0.05] = np.nan
    z[4:16, 8:22] = np.nan
    return z


def box(a, ok, r):
    pad = lambda x: np.pad(x, r, "edge")
    v, m = pad(np.where(ok, a, 0)), pad(ok.astype(float))
    out = np.zeros(a.shape)
    for i, j in np.ndindex(*a.shape):
        n = m[i : i + 2 * r + 1, j : j + 2 * r + 1].sum()
        out[i, j] = v[i : i + 2 * r + 1, j : j + 2 * r + 1].sum() / n if n else 0
    return out


@pytest.mark.parametrize("chunk", [8, 16, 64])
def test_guided_filter(spark, holed, chunk):
    guide = np.random.default_rng(4).random(holed.shape)
    ok = np.isfinite(holed)
    p, g, r = np.where(ok, holed, 0), np.where(ok, guide, 0), 2
    mp, mg = box(p, ok, r), box(g, ok, r)
    a = (box(g * p, ok, r) - mg * mp) / (box(g * g, ok, r) - mg * mg + 1e-3)
    want = np.where(ok, box(a, ok, r) * g + box(mp - a * mg, ok, r), np.nan)
    got = grid(halo.guided_filter(scene(spark, z=holed, guide=guide), r, 1e-3, chunk), "q", holed.shape)
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("chunk", [8, 64])
@pytest.mark.parametrize("rounds", [3, 64])
def test_fill_invalid(spark, holed, chunk, rounds):
    out = holed.copy()
    for _ in range(rounds):
        now = out.copy()
        for i, j in zip(*np.nonzero(np.isnan(out))):
            near = out[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            if np.isfinite(near).any():
                now[i, j] = np.nanmean(near)
        out = now
    out[np.isnan(out)] = np.nanmean(out)
    assert np.allclose(grid(halo.fill_invalid(scene(spark, z=holed), rounds, chunk), "z", holed.shape), out)


def test_fill_invalid_without_a_value(spark):
    assert {r.z for r in halo.fill_invalid(scene(spark, z=np.full((4, 5), np.nan))).collect()} == {0.0}


@pytest.mark.parametrize("chunk", [8, 64])
def test_ground_surface(spark, holed, chunk):
    whole = np.pad(np.where(np.isnan(holed), np.nanmedian(holed), holed), (3, 2), "symmetric")
    want = np.array([[np.median(whole[i : i + 6, j : j + 6]) for j in range(holed.shape[1])] for i in range(holed.shape[0])])
    assert np.allclose(grid(halo.ground_surface(scene(spark, z=holed), 6, chunk), "ground", holed.shape), want)


@pytest.mark.parametrize("conn", [4, 8])
def test_components_whatever_the_chunk(spark, conn):
    mask = np.random.default_rng(5).random((40, 50)) < 0.5
    df = spark.createDataFrame([(0, int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "scene_id long, row int, col int")
    lab, seen = {}, set()
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        stack = [start]
        seen.add(start)
        while stack:
            r, c = stack.pop()
            lab[int(r), int(c)] = tuple(map(int, start))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if (conn == 8 or abs(dr) + abs(dc) == 1) and 0 <= n[0] < 40 and 0 <= n[1] < 50 and mask[n] and n not in seen:
                        seen.add(n)
                        stack.append(n)
    for chunk in (8, 64):
        got = {(r["row"], r["col"]): (r.label_row, r.label_col) for r in components.label_components(df, conn, chunk).collect()}
        assert got == lab


def test_roughness_at_a_limit(spark):
    """A window of whole heights whose deviation is a limit exactly is not beyond it."""
    from gridspark.operators import costs

    rnd = np.random.default_rng(7)
    vehicles = spark.createDataFrame([("a", 90.0, 1e9, 2.0), ("b", 90.0, 1e9, 0.4)], "vehicle string, max_slope double, max_step double, max_rough double")
    a = np.stack([rnd.permutation([100 + k] * 13 + [100 + k + 5] * 12).reshape(5, 5) for k in range(30)] + [rnd.integers(90, 99, (5, 5)) for _ in range(400)])
    px = spark.createDataFrame([(s, r, c, float(a[s, r, c])) for s in range(len(a)) for r in range(5) for c in range(5)], "scene_id long, row int, col int, z double")
    spread = {s: int(25 * (a[s] ** 2).sum() - a[s].sum() ** 2) for s in range(len(a))}
    got = {(r.scene_id, r.vehicle): (r.rough, r.cls) for r in costs.classify_passability(px, vehicles, 5, 5, 1e9).where("row = 2 and col = 2").collect()}
    for s, v in spread.items():
        assert got[s, "a"] == ((v / 625) ** 0.5, 2 if v > 4 * 625 else 1 if v > 2.25 * 625 else 0)


def test_peaks_send_no_windows(spark):
    """Peaks against loops, points on missing pixels and NaN too; the plan takes no window of a point apart."""
    rnd = np.random.default_rng(11)
    z = rnd.normal(0, 5, (20, 30))
    z[rnd.random(z.shape) < 0.2] = np.nan
    px = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(20) for c in range(30)], "scene_id long, row int, col int, z double")
    places = [(int(r), int(c)) for r, c in rnd.integers(-4, 34, (80, 2))]
    points = spark.createDataFrame([(i, 1, *p) for i, p in enumerate(places)], "point_id long, scene_id long, row int, col int")
    made = halo.structure_peak(points, px, 3)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 2  # the chunks of a pixel, in rows and in columns
    want = {}
    for i, (r, c) in enumerate(places):
        near = z[max(r - 3, 0) : max(r + 4, 0), max(c - 3, 0) : max(c + 4, 0)]
        if near.size and np.isfinite(near).any():
            own = z[r, c] if 0 <= r < 20 and 0 <= c < 30 else np.nan
            want[i] = None if np.isnan(own) else float(np.nanmax(near) - own)
    assert {r.point_id: r.peak for r in made.collect()} == want
