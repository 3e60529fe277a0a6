"""Passability and travel costs of vehicles over terrain, classes and damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import distance, focal, halo

# Weights of the classes building, vegetation, road, water, ground, other, and the factors of damage 1 to 4.
WEIGHTS = [1000.0, 4.0, 0.65, 1000.0, 1.0, 1.5]
DAMAGE = {2: 3.0, 3: 20.0, 4: 50.0}
HARD_BLOCK = 0.9
# Colours of the risk overlay.
RISK = {"destroyed": (211, 47, 47), "major": (255, 87, 34), "blocked": (231, 76, 60), "road": (39, 174, 96), "ground": (46, 204, 113), "vegetation": (230, 126, 34), "caution": (241, 196, 15), "other": (149, 165, 166)}


def soft_cost(slope: F.Column, step: F.Column, cls: F.Column, max_slope: float, max_step: float) -> F.Column:
    """Cost of a cell; limits count as 0.000001 at least, cautious cells (1) cost half as much again, cells from class 2 up are blocked."""
    base = 1 + 4 * F.pow(slope / max(max_slope, 1e-6), 2) + 3 * F.pow(step / max(max_step, 1e-6), 2)
    return F.when(cls >= 2, 1e9).when(cls == 1, base * 1.5).otherwise(base)


def semantic_cost(probs: F.Column, conf: F.Column, vegetation: float = WEIGHTS[1]) -> tuple[F.Column, F.Column]:
    """Factor by class probabilities, blended with that of ``other`` where uncertain, and whether building or water block."""
    weights = F.array(*(F.lit(vegetation if i == 1 else w) for i, w in enumerate(WEIGHTS)))
    raw = F.aggregate(F.zip_with(probs, weights, lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)
    return conf * raw + (1 - conf) * WEIGHTS[5], (probs[0] >= HARD_BLOCK) | (probs[3] >= HARD_BLOCK)


def damage_cost(label: F.Column) -> tuple[F.Column, F.Column]:
    """Factor of a damage label, and whether it blocks (destroyed)."""
    out = F.lit(1.0)
    for k, v in DAMAGE.items():
        out = F.when(label == k, v).otherwise(out)
    return out, label == 4


def combined(costs: list[tuple[F.Column, F.Column]]) -> tuple[F.Column, F.Column]:
    """Product of costs; any of them may block."""
    cost, blocked = costs[0]
    for c, b in costs[1:]:
        cost, blocked = cost * c, blocked | b
    return cost, blocked


def risk_class(cls: F.Column, probs: F.Column, damage: F.Column) -> F.Column:
    """What an overlay shows, the most urgent first."""
    top = F.array_position(probs, F.array_max(probs)) - 1
    return (
        F.when(damage == 4, "destroyed").when(damage == 3, "major").when((cls == 2) | (probs[0] >= 0.7) | (probs[3] >= 0.7), "blocked")
        .when(top == 2, "road").when((top == 4) & (cls == 0), "ground").when(top == 1, "vegetation").when(cls == 1, "caution").otherwise("other")
    )


def passability(slope: F.Column, step: F.Column, rough: F.Column, max_slope: F.Column, max_step: F.Column, max_rough: F.Column) -> F.Column:
    """0 free, 1 within a quarter of a limit, 2 beyond one."""
    beyond = lambda k: (slope > k * max_slope) | (step > k * max_step) | (rough > k * max_rough)
    return F.when(beyond(1.0), 2).when(beyond(0.75), 1).otherwise(0)


def classify_passability(px: DataFrame, vehicles: DataFrame, height: int, width: int, gsd: float | None, cap: int = 1024) -> DataFrame:
    """Slope, step, roughness and class of every cell for each of the few ``vehicles(vehicle, max_slope, max_step, max_rough)``.

    Scenes over ``cap`` cells are averaged in blocks first. Without a ground distance only slope counts.
    """
    factor = max(1, -(-max(height, width) // cap))
    grid = focal.block_mean(px, factor, height, width) if factor > 1 else px.select("scene_id", "row", "col", "z")
    grid = halo.terrain(grid, (gsd or 1.0) * factor)
    grid = grid if gsd else grid.withColumns({"step": F.lit(0.0), "rough": F.lit(0.0)})
    both = grid.crossJoin(F.broadcast(vehicles))  # a table of profiles
    limit = lambda c: F.col(c) if gsd else F.lit(float("inf"))
    return both.select("scene_id", "vehicle", "row", "col", "slope", "step", "rough", passability(F.col("slope"), F.col("step"), F.col("rough"), F.col("max_slope"), limit("max_step"), limit("max_rough")).alias("cls"))


def passability_pct(cells: DataFrame) -> DataFrame:
    """Free, caution and blocked shares in percent by scene and vehicle."""
    share = lambda k: F.avg((F.col("cls") == k).cast("double")) * 100
    return cells.groupBy("scene_id", "vehicle").agg(share(0).alias("free_pct"), share(1).alias("caution_pct"), share(2).alias("blocked_pct"))


def nearest_reachable(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """The cell of ``cells(scene_id, row, col)`` nearest to each of ``targets(point_id, scene_id, trow, tcol)``; equal distances go to the first in row-major order.

    Only the rows of targets are looked at, in each column that has a cell (see ``distance.nearest_seed``), never all cells for each target.
    """
    yes, no = F.lit(True), F.lit(False)
    place = ["scene_id", "row", "col"]
    asked = targets.select("scene_id", F.col("trow").alias("row"), F.col("tcol").alias("col"))
    probes = asked.select("scene_id", "row").distinct().join(cells.select("scene_id", "col").distinct(), "scene_id")
    every = cells.select(*place, no.alias("hot"), yes.alias("seed")).unionByName(probes.select(*place, no.alias("hot"), no.alias("seed"))).unionByName(asked.select(*place, yes.alias("hot"), no.alias("seed")))
    found = distance.nearest_seed(every.groupBy(*place).agg(F.max("hot").alias("hot"), F.max("seed").alias("seed")))
    at = targets.select("point_id", "scene_id", F.col("trow").alias("row"), F.col("tcol").alias("col"))
    return at.join(found, place).select("point_id", F.col("seed_row").alias("row"), F.col("seed_col").alias("col"), "d2")


def nearest_standable(cells: DataFrame, points: DataFrame, radius: int = 64) -> DataFrame:
    """The nearest open cell by square rings around each point: the first ring with one counts, in it the shortest way; beyond ``radius`` there is none.

    Points meet cells by squares as wide as the radius, so only near ones are compared.
    """
    square = lambda c: F.floor(F.col(c) / max(1, radius))
    side = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    asked = points.select("point_id", "scene_id", "trow", "tcol", side.alias("a")).select("*", side.alias("b"))
    asked = asked.select("point_id", "scene_id", "trow", "tcol", (square("trow") + F.col("a")).alias("y"), (square("tcol") + F.col("b")).alias("x"))
    dr, dc = F.col("row") - F.col("trow"), F.col("col") - F.col("tcol")
    ring = F.greatest(F.abs(dr), F.abs(dc), F.lit(1))
    near = cells.select("scene_id", "row", "col", square("row").alias("y"), square("col").alias("x")).join(asked, ["scene_id", "y", "x"]).where((F.abs(dr) <= radius) & (F.abs(dc) <= radius))
    best = near.groupBy("point_id").agg(F.min(F.struct(ring.alias("ring"), (dr * dr + dc * dc).cast("long").alias("d2"), "row", "col")).alias("x"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", "x.row", "x.col", "x.d2")


def path_stats(path: DataFrame, gsd: float, speed: float, slope_limit: float) -> DataFrame:
    """Length, steepest cell, cautious share and time of each ``path(path_id, seq, row, col, slope, cls)``.

    A segment's time goes by the speed at its first cell, which falls with slope to 15 % at least.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path_id").orderBy("seq")
    length = F.hypot(F.lead("row").over(w) - F.col("row"), F.lead("col").over(w) - F.col("col")) * gsd
    pace = speed * F.greatest(1 - F.col("slope") / slope_limit, F.lit(0.15))
    seg = path.withColumn("length", length).withColumn("time", F.col("length") / pace)
    return seg.groupBy("path_id").agg(F.sum("length").alias("length_m"), F.max("slope").alias("max_slope"), F.avg((F.col("cls") == 1).cast("double")).alias("caution"), F.sum("time").alias("time_s"), F.count("*").alias("n"))
