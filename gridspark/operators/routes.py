"""Least-cost paths over scenes cut into chunks.

Within a chunk costs spread from those at which the chunk can be entered until none falls; many routes and chunks are settled
at once as arrays. Between chunks only the entries are exchanged. A round runs the chunks whose entries have fallen and offers
their neighbours new ones, until none falls. What is kept is a row for each entered chunk of each route with the border cells of its
entries, never a route's whole field. Nothing that costs more than the goal does already is offered, and settled routes are put aside,
so later rounds go with the routes still open. Equal routes are searched once. Equal costs are decided by the first neighbour in
row-major order, so neither cost nor path depends on the size of chunks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import inf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut, forget

CHUNK = 128
CELLS = 1 << 17
"""So many cells of chunks are settled at once, more only if a single chunk has more."""
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_OUTSIDE, _START = len(_AROUND), len(_AROUND) + 1
_PLAIN = {"parquet.enable.dictionary": "false"}
"""Costs repeat so much that a dictionary makes files a small part of their rows; joins are chosen by the size of files."""


def _shifted(a: int, b: int) -> tuple[tuple, tuple]:
    """Slices of cells and of their neighbours at ``(a, b)``."""
    cut_ = lambda k: (slice(max(0, -k), -k if k > 0 else None), slice(max(0, k), k if k < 0 else None))
    (r, nr), (c, nc) = cut_(a), cut_(b)
    return (slice(None), r, c), (slice(None), nr, nc)


_SHIFTS = [(*_shifted(a, b), bool(a and b)) for a, b in _AROUND]


def cost_chunks(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, cr, cc, row0, col0, width, cost)``: chunks of ``cells(scene_id, row, col, cost)`` with one cell more to each side, as rows of doubles; cells that are missing or whose cost is null, not finite or not above 0 are blocked."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / chunk), F.floor((F.col(c) + 1) / chunk)))
    open_cells = cells.where("cost > 0 and cost < double('Infinity')").select("scene_id", "row", "col", F.col("cost").cast("double").alias("cost"))
    sent = open_cells.select("*", span("row").alias("cr")).select("*", span("col").alias("cc")).where("cr >= 0 and cc >= 0")
    met = sent.groupBy("scene_id", "cr", "cc").agg(F.collect_list(F.struct("row", "col", "cost")).alias("cells"))

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {n: [] for n in ("row0", "col0", "width", "cost")}
            for k in range(batch.num_rows):
                own = batch["cells"][k].values
                row, col = (own.field(n).to_numpy() for n in ("row", "col"))
                r0, c0 = int(row.min()), int(col.min())
                grid = np.full((row.max() - r0 + 1, col.max() - c0 + 1), inf)
                grid[row - r0, col - c0] = own.field("cost").to_numpy()
                for n, v in zip(made, (r0, c0, grid.shape[1], grid.ravel())):
                    made[n].append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("scene_id", "cr", "cc")), *(pa.array(v, t) for v, t in zip(made.values(), kinds))], names=["scene_id", "cr", "cc", *made])

    return met.mapInArrow(grids, "scene_id long, cr long, cc long, row0 int, col0 int, width int, cost array<double>")


def _by_heap(d: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Costs of one chunk from those known, by Dijkstra's method."""
    height, width = d.shape
    d, step = d.tolist(), step.tolist()
    heap = [(v, y, x) for y, line in enumerate(d) for x, v in enumerate(line) if v < inf]
    heapq.heapify(heap)
    while heap:
        g, r, c = heapq.heappop(heap)
        if g > d[r][c]:
            continue
        for a, b in _AROUND:
            y, x = r + a, c + b
            if 0 <= y < height and 0 <= x < width:
                new = g + (sqrt(2.0) if a and b else 1.0) * step[y][x]
                if new < d[y][x]:
                    d[y][x] = new
                    heapq.heappush(heap, (new, y, x))
    return np.array(d)


def _settle(d: np.ndarray, step: np.ndarray) -> None:
    """Spread the costs ``d`` of many chunks in place until none falls. ``step`` is what it costs to enter a cell.

    Every sweep takes each cell's least cost over its neighbours. A chunk whose paths wind through it more than a few times goes on by
    Dijkstra's method. Sums run along the path in both, so the costs are the same to the last bit.
    """
    left, now, straight, across = np.arange(len(d)), d.copy(), step, sqrt(2.0) * step
    for _ in range(2 * sum(d.shape[1:])):
        before = now.copy()
        for own, other, diagonal in _SHIFTS:
            np.minimum(now[own], now[other] + (across if diagonal else straight)[own], out=now[own])
        moves = (now != before).any((1, 2))
        if 2 * moves.sum() <= len(left):
            d[left] = now
            left, now, straight, across = left[moves], now[moves], straight[moves], across[moves]
            if not len(left):
                return
    for k, own, s in zip(left, now, straight):
        d[k] = _by_heap(own, s)


class _Fields:
    """Costs of the cells of many chunks, each for one route, from its entries there."""

    def __init__(self, rows: pa.RecordBatch, chunk: int):
        a = {n: rows[n].to_numpy() for n in ("cr", "cc", "row0", "col0", "width")}
        self.row0, self.col0 = a["row0"].astype(np.int64), a["col0"].astype(np.int64)
        n, flat = np.diff(rows["cost"].offsets.to_numpy()), rows["cost"].flatten().to_numpy()
        shape = (rows.num_rows, int((n // a["width"]).max()), int(a["width"].max()))
        at = np.repeat(np.arange(len(n)), n)
        y, x = np.divmod(np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), a["width"][at])
        self.cost = np.full(shape, inf)
        self.cost[at, y, x] = flat
        within = lambda first, size, k: (first[:, None] + np.arange(size)) // chunk == k[:, None]
        self.inside = within(self.row0, shape[1], a["cr"])[:, :, None] & within(self.col0, shape[2], a["cc"])[:, None, :]
        self.step = np.where(self.inside, self.cost, inf)
        entries, many = rows["entries"].flatten(), np.diff(rows["entries"].offsets.to_numpy())
        self.e = {f: entries.field(f).to_numpy(zero_copy_only=False) for f in ("row", "col", "d")}
        self.e |= {f: entries.field(f).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("prow", "pcol")}
        self.e["start"] = entries.field("prow").is_null().to_numpy(zero_copy_only=False)
        self.at = np.repeat(np.arange(len(many)), many)
        self.at = (self.at, self.e["row"] - self.row0[self.at], self.e["col"] - self.col0[self.at])
        self.d = np.full(shape, inf)
        self.d[self.at] = self.e["d"]
        _settle(self.d, self.step)

    def place(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chunks and places in them of one cell for each chunk, where that lies in the chunk and is reached."""
        y, x = row - self.row0, col - self.col0
        k = np.flatnonzero((y >= 0) & (x >= 0) & (y < self.d.shape[1]) & (x < self.d.shape[2]))
        k = k[self.d[k, y[k], x[k]] < inf]
        return k, y[k], x[k]

    def offers(self) -> tuple[np.ndarray, ...]:
        """Chunk, row, column, cost and the cell before it of each cell beyond a chunk that can be entered from it."""
        beyond = np.where(self.inside, inf, self.cost)
        least, by = np.full(self.d.shape, inf), np.zeros(self.d.shape, np.int8)
        for k, (own, other, diagonal) in enumerate(_SHIFTS):
            new = self.d[other] + (sqrt(2.0) if diagonal else 1.0) * beyond[own]
            less = new < least[own]
            least[own][less] = new[less]
            by[own][less] = k
        k, y, x = at = np.nonzero(least < inf)
        row, col, (a, b) = y + self.row0[k], x + self.col0[k], np.array(_AROUND)[by[at]].T
        return k, row, col, least[at], row + a, col + b

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each cell the number of the neighbour that it is reached from, ``_OUTSIDE`` or ``_START``, and the place of its cell outside."""
        by = np.full(self.d.shape, -1, np.int8)
        for k, (own, other, diagonal) in reversed(list(enumerate(_SHIFTS))):
            equal = self.d[other] + (sqrt(2.0) if diagonal else 1.0) * self.step[own] == self.d[own]
            by[own][equal & (self.d[own] < inf)] = k
        prow, pcol = np.zeros(self.d.shape, np.int64), np.zeros(self.d.shape, np.int64)
        prow[self.at], pcol[self.at] = self.e["prow"], self.e["pcol"]
        k = by[self.at]
        a, b = np.array([*_AROUND, (0, 0)])[k].T
        row, col = self.e["row"] + a, self.e["col"] + b
        first = (k < 0) | (self.e["prow"] < row) | ((self.e["prow"] == row) & (self.e["pcol"] < col))
        least = self.e["d"] == self.d[self.at]
        by[self.at] = np.where(self.e["start"] & least, _START, np.where(least & first, _OUTSIDE, k))
        return by, prow, pcol


def _fields(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[pa.RecordBatch, _Fields]]:
    """Rows of routes with their entries and chunks, some at a time, and their fields."""
    for batch in batches:
        size, begun = np.diff(batch["cost"].offsets.to_numpy()), 0
        largest = np.maximum.accumulate(size) if len(size) else size
        while begun < batch.num_rows:
            n = max(1, CELLS // int(largest[-1]))
            rows = batch.slice(begun, n)
            yield rows, _Fields(rows, chunk)
            begun += n


def _at(chunk: int, row: str = "row", col: str = "col") -> list:
    return [F.floor(F.col(row) / chunk).alias("cr"), F.floor(F.col(col) / chunk).alias("cc")]


ROUTE = ["route_id", "scene_id", "goal_row", "goal_col"]
STATE = [*ROUTE, "cr", "cc", "goal"]
_CELL = "row int, col int, d double, prow int, pcol int"


def _spread(asked: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """What each asked chunk offers to cells of its neighbours, up to the cost ``bound`` of its route, and the cost of the goal in it (``goal``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fields in _fields(batches, chunk):
            offers = fields.offers()
            useful = offers[3] <= rows["bound"].to_numpy()[offers[0]]
            k, row, col, d, prow, pcol = (v[useful] for v in offers)
            own, y, x = fields.place(rows["goal_row"].to_numpy(), rows["goal_col"].to_numpy())
            none = np.full(len(own), -1)
            told = [np.concatenate(v) for v in ((row, rows["goal_row"].to_numpy()[own]), (col, rows["goal_col"].to_numpy()[own]), (d, fields.d[own, y, x]), (prow, none), (pcol, none))]
            goal = np.arange(len(told[0])) >= len(k)
            of = rows.select(ROUTE).take(pa.array(np.concatenate((k, own))))
            cells = [pa.array(v, t, mask=goal if n > 2 else None) for n, (v, t) in enumerate(zip(told, (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())))]
            yield pa.RecordBatch.from_arrays([*of.columns, *cells, pa.array(goal)], names=[*ROUTE, "row", "col", "d", "prow", "pcol", "goal"])

    return asked.join(chunks, ["scene_id", "cr", "cc"]).select(*ROUTE, "cr", "cc", "bound", "entries", "row0", "col0", "width", "cost").mapInArrow(run, f"route_id long, scene_id long, goal_row int, goal_col int, {_CELL}, goal boolean")


def _search(routes: DataFrame, chunks: DataFrame, chunk: int, paths: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Final entries of every route, by chunk, if ``paths`` are asked, and ``(route_id, cost)`` of its goal.

    A chunk whose new entries all cost more than the goal does already is not run. A route without a chunk to run is settled; once half
    of the routes that rounds carry are, these are put aside.
    """
    own = F.struct(F.col("start_row").alias("row"), F.col("start_col").alias("col"), F.lit(0.0).alias("d"), F.lit(None).cast("int").alias("prow"), F.lit(None).cast("int").alias("pcol"), F.lit(True).alias("fell"))
    state = cut(routes.select(*ROUTE, *_at(chunk, "start_row", "start_col"), F.lit(False).alias("goal"), F.array(own).alias("entries"), F.lit(0.0).alias("front")))
    front = lambda of: F.min(F.when(of, F.col("front")))
    settled, fields = [], []
    while True:
        bound = F.coalesce(front(F.col("goal")), F.lit(inf))
        ends = cut(state.groupBy("route_id").agg(bound.alias("bound"), F.coalesce(front(~F.col("goal")) <= bound, F.lit(False)).alias("open")))
        carried, left = ends.agg(F.count("*"), F.count_if("open")).first()
        if not left:
            break
        active = cut(state.where("not goal").join(ends.where("open"), "route_id").where("front <= bound").drop("goal", "front", "open"), **_PLAIN)
        kept = state
        if aside := 2 * left <= carried:
            settled.append(ends.where("not open"))
            if paths:
                fields.append(cut(state.join(ends.where("not open"), "route_id", "left_semi")))
            kept = state.join(ends.where("open"), "route_id", "left_semi")
        told = _spread(active, chunks, chunk).select(*ROUTE, *_at(chunk), "goal", "row", "col", "d", "prow", "pcol", F.lit(False).alias("known"))
        kept = kept.select(*STATE, F.inline("entries")).drop("fell").withColumn("known", F.lit(True))
        # dealt by route and chunk once, for cells and for chunks
        both = told.unionByName(kept).repartition("route_id", "cr", "cc")
        least = both.groupBy(*STATE, "row", "col").agg(F.min(F.struct("d", "prow", "pcol")).alias("x"), F.min(F.when(F.col("known"), F.col("d"))).alias("before"))
        fell = F.col("before").isNull() | (F.col("x.d") < F.col("before"))
        entry = F.struct("row", "col", "x.d", "x.prow", "x.pcol", fell.alias("fell"))
        old, state = state, cut(least.groupBy(*STATE).agg(F.collect_list(entry).alias("entries"), F.min(F.when(F.col("goal") | fell, F.col("x.d"))).alias("front")))
        forget(old, active, *([] if aside else [ends]))
    best = reduce(DataFrame.unionByName, [*settled, ends]).where("bound < double('Infinity')").select("route_id", F.col("bound").alias("cost"))
    return reduce(DataFrame.unionByName, [*fields, state]).where("not goal").drop("goal", "front") if paths else None, best


def _walk(asked: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """The part of each path in the chunk where it stands, from its end backwards, and the cell of another chunk from which it came (``next``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fields in _fields(batches, chunk):
            by, prow, pcol = fields.parents()
            go = np.array(_AROUND)
            back = rows["back"].to_numpy()
            k, y, x = fields.place(rows["row"].to_numpy(), rows["col"].to_numpy())
            parts, n = [], 0
            while len(k):
                parts.append((k, y + fields.row0[k], x + fields.col0[k], back[k] + n, np.zeros(len(k), bool)))
                code = by[k, y, x]
                away, inner, n = code == _OUTSIDE, code < _OUTSIDE, n + 1
                out = (k[away], y[away], x[away])
                parts.append((k[away], prow[out], pcol[out], back[k[away]] + n, np.ones(away.sum(), bool)))
                k, y, x = k[inner], y[inner] + go[code[inner], 0], x[inner] + go[code[inner], 1]
            if parts:
                k, *told = (np.concatenate(v) for v in zip(*parts))
                yield pa.RecordBatch.from_arrays([rows["route_id"].take(pa.array(k)), *(pa.array(v, t) for v, t in zip(told, (pa.int32(), pa.int32(), pa.int32(), pa.bool_())))], names=["route_id", "row", "col", "back", "next"])

    return asked.join(chunks, ["scene_id", "cr", "cc"]).select("route_id", "row", "col", "back", "cr", "cc", "entries", "row0", "col0", "width", "cost").mapInArrow(run, "route_id long, row int, col int, back int, next boolean")


def least_cost(cells: DataFrame, routes: DataFrame, chunk: int = CHUNK, paths: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``(route_id, cost)`` and, if asked, ``(route_id, seq, row, col)`` of the cheapest path of each of ``routes(route_id, scene_id, start_row, start_col, goal_row, goal_col)``.

    A step to one of eight neighbours costs its length times the cost of the cell it leads to; corners may be
    cut. Blocked cells (see ``cost_chunks``) are not entered; a route whose start or goal is blocked, null or outside its scene, or
    whose goal cannot be reached, has a null cost and no path. Paths run from the start (seq 0) to the goal. Route ids are unique.
    """
    chunks = cut(cost_chunks(cells, chunk), **_PLAIN)
    routes = cut(routes)
    ends = ["scene_id", "start_row", "start_col", "goal_row", "goal_col"]
    ok = routes.groupBy(*ends).agg(F.min("route_id").alias("route_id"))
    for end in ("start", "goal"):
        y, x = F.col(f"{end}_row") - F.col("row0"), F.col(f"{end}_col") - F.col("col0")
        is_open = (y >= 0) & (x >= 0) & (x < F.col("width")) & (F.get("cost", y * F.col("width") + x) < inf)
        ok = ok.select("*", *_at(chunk, f"{end}_row", f"{end}_col")).join(chunks, ["scene_id", "cr", "cc"]).where(is_open).select(*ends, "route_id")
    ok = cut(ok)
    entries, best = _search(ok, chunks, chunk, paths)
    of = routes.join(ok.join(best, "route_id").select(*ends, F.col("route_id").alias("same"), "cost"), ends)
    costs = routes.select("route_id").join(of.select("route_id", "cost"), "route_id", "left")
    if not paths:
        return costs, None
    now = ok.join(best, "route_id").select("route_id", F.col("goal_row").alias("row"), F.col("goal_col").alias("col"), F.lit(0).alias("back"))
    fields = entries.select("route_id", "scene_id", "cr", "cc", "entries")
    steps = None
    while True:
        part = cut(_walk(now.select("*", *_at(chunk)).join(fields, ["route_id", "cr", "cc"]), chunks, chunk))
        own = part.where("not next").select("route_id", "back", "row", "col")
        steps = own if steps is None else steps.unionByName(own)
        now = part.where("next").select("route_id", "row", "col", "back")
        if now.isEmpty():
            break
    steps = steps.withColumnRenamed("route_id", "same")
    total = steps.groupBy("same").agg(F.max("back").alias("last"))
    return costs, of.select("route_id", "same").join(total, "same").join(steps, "same").select("route_id", (F.col("last") - F.col("back")).alias("seq"), "row", "col")
