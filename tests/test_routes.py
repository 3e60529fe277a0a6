"""Routes against Dijkstra's method on whole scenes, for several sizes of chunks."""

import heapq
import math

import numpy as np
import pytest

from gridspark.operators import routes


def dijkstra(cost, start, goal):
    """Cost and path; of equal costs the first neighbour in row-major order is the parent."""
    if not all(0 <= r < cost.shape[0] and 0 <= c < cost.shape[1] and np.isfinite(cost[r, c]) and cost[r, c] > 0 for r, c in (start, goal)):
        return None, None
    d, heap = {start: 0.0}, [(0.0, start)]
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    inside = lambda y, x: 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1] and np.isfinite(cost[y, x]) and cost[y, x] > 0
    done = set()
    while heap:
        g, (r, c) = heapq.heappop(heap)
        if (r, c) in done:
            continue
        done.add((r, c))
        for a, b in around:
            y, x = r + a, c + b
            if inside(y, x):
                new = g + (math.sqrt(2.0) if a and b else 1.0) * float(cost[y, x])
                if new < d.get((y, x), math.inf):
                    d[y, x] = new
                    heapq.heappush(heap, (new, (y, x)))
    if goal not in d:
        return None, None
    path = [goal]
    while path[-1] != start:
        y, x = path[-1]
        path.append(min((y + a, x + b) for a, b in around if (y + a, x + b) in d and d[y + a, x + b] + (math.sqrt(2.0) if a and b else 1.0) * float(cost[y, x]) == d[y, x]))
    return d[goal], path[::-1]


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(11)
    rough = rng.random((25, 30)) * 3 + 0.1
    rough[rng.random(rough.shape) < 0.15] = np.nan
    flat = np.ones((20, 27))
    snake = np.ones((15, 15))
    for k in range(3, 15, 4):
        snake[k] = np.nan
        snake[k, (0, 14)[k // 4 % 2]] = 1
    island = np.ones((18, 18))
    island[5:12, 5:12] = np.inf
    island[7:10, 7:10] = 0.01
    island[0, 9] = 0.0
    return {4: rough, 7: flat, 8: snake, 9: island}


@pytest.mark.parametrize("chunk", [8, 16, 64])
def test_equals_dijkstra(spark, scenes, chunk):
    rng = np.random.default_rng(5)
    rows = [(s, int(r), int(c), float(a[r, c])) for s, a in scenes.items() for r, c in np.ndindex(*a.shape) if not (np.isnan(a[r, c]) and r % 2)]
    cells = spark.createDataFrame(rows, "scene_id long, row int, col int, cost double")
    asked = [(8, (0, 0), (14, 14)), (7, (19, 26), (0, 3)), (7, (4, 4), (4, 4)), (9, (0, 0), (8, 8)), (9, (0, 0), (17, 17)), (9, (8, 8), (7, 7)), (9, (-1, 3), (2, 2)), (5, (0, 0), (1, 1)), (9, (1, 1), (40, 1))]
    for s, a in scenes.items():
        asked += [(s, (int(rng.integers(a.shape[0])), int(rng.integers(a.shape[1]))), (int(rng.integers(a.shape[0])), int(rng.integers(a.shape[1])))) for _ in range(8)]
    table = spark.createDataFrame([(i, s, *a, *b) for i, (s, a, b) in enumerate(asked)], "route_id long, scene_id long, start_row int, start_col int, goal_row int, goal_col int")
    costs, paths = routes.least_cost(cells, table, chunk)
    cost = {r.route_id: r.cost for r in costs.collect()}
    steps = {}
    for r in sorted(paths.collect(), key=lambda r: (r.route_id, r.seq)):
        assert r.seq == len(steps.setdefault(r.route_id, []))
        steps[r.route_id].append((r.row, r.col))
    for i, (s, a, b) in enumerate(asked):
        want, path = dijkstra(scenes.get(s, np.zeros((0, 0))), a, b)
        assert cost[i] == want, (i, s, a, b)
        assert steps.get(i) == path, (i, s, a, b)
    assert sum(c is None for c in cost.values()) >= 4


def test_no_routes(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None)], "scene_id long, row int, col int, cost double")
    kind = "route_id long, scene_id long, start_row int, start_col int, goal_row int, goal_col int"
    costs, paths = routes.least_cost(cells, spark.createDataFrame([], kind))
    assert costs.count() == paths.count() == 0
    costs, paths = routes.least_cost(cells, spark.createDataFrame([(1, 0, 0, 0, 0, 1), (2, None, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)], kind))
    assert {r.route_id: r.cost for r in costs.collect()} == {1: None, 2: None, 3: 0.0} and paths.collect()[0].seq == 0


def test_equal_routes_are_searched_once(spark, scenes, monkeypatch):
    """Copies of a route take no search of their own and still have its cost and path."""
    cells = spark.createDataFrame([(4, r, c, float(v)) for (r, c), v in np.ndenumerate(scenes[4]) if np.isfinite(v)], "scene_id long, row int, col int, cost double")
    (a, b), *_ = [p for p in (((0, 1), (23, 28)), ((1, 0), (24, 27)), ((2, 2), (20, 20))) if dijkstra(scenes[4], *p)[0]]
    searched, search = [], routes._search
    monkeypatch.setattr(routes, "_search", lambda asked, *args: searched.append(asked.count()) or search(asked, *args))
    table = spark.createDataFrame([(i, 4, *(a if i % 2 else b), *(b if i % 2 else a)) for i in range(20)], "route_id long, scene_id long, start_row int, start_col int, goal_row int, goal_col int")
    costs, paths = routes.least_cost(cells, table, 16)
    want = [dijkstra(scenes[4], *p) for p in ((b, a), (a, b))]
    steps = {}
    for r in sorted(paths.collect(), key=lambda r: (r.route_id, r.seq)):
        steps.setdefault(r.route_id, []).append((r.row, r.col))
    assert {r.route_id: (r.cost, steps[r.route_id]) for r in costs.collect()} == {i: want[i % 2] for i in range(20)}
    assert searched == [2]


def test_settled_by_sweeps_and_by_heap():
    """A chunk whose path winds more often than the sweeps allow has the costs of Dijkstra's method to the last bit, beside one that does not."""
    rng = np.random.default_rng(3)
    step = rng.random((2, 22, 21)) + 0.01
    for k in range(1, 21, 2):
        step[0, k] = math.inf
        step[0, k, (0, 20)[k // 2 % 2]] = 0.5
    d = np.full(step.shape, math.inf)
    d[:, 0, 10] = 0.0
    want = np.stack([routes._by_heap(a, b) for a, b in zip(d, step)])
    routes._settle(d, step)
    assert (d == want).all() and np.isfinite(d[0, 20]).all()


def test_settled_routes_are_put_aside(spark, scenes, monkeypatch):
    """Rounds for one long winding route carry no longer the many short ones that are settled, and all keep their costs and paths."""
    cells = spark.createDataFrame([(8, r, c, float(v)) for (r, c), v in np.ndenumerate(scenes[8]) if np.isfinite(v)], "scene_id long, row int, col int, cost double")
    asked = [((0, 0), (14, 14)), *(((0, c), (1, c)) for c in range(12))]
    carried, written = [], routes.cut

    def count(df, **options):
        out = written(df, **options)
        if "entries" in out.columns and "goal" in out.columns and not options:
            carried.append(out.select("route_id").distinct().count())
        return out

    monkeypatch.setattr(routes, "cut", count)
    table = spark.createDataFrame([(i, 8, *a, *b) for i, (a, b) in enumerate(asked)], "route_id long, scene_id long, start_row int, start_col int, goal_row int, goal_col int")
    costs, paths = routes.least_cost(cells, table, 8)
    assert carried[0] == 13 and carried[-1] == 1
    steps = {}
    for r in sorted(paths.collect(), key=lambda r: (r.route_id, r.seq)):
        steps.setdefault(r.route_id, []).append((r.row, r.col))
    assert {r.route_id: (r.cost, steps[r.route_id]) for r in costs.collect()} == {i: dijkstra(scenes[8], a, b) for i, (a, b) in enumerate(asked)}
