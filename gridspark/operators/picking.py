"""Which feature lies under a point: a join of points and polygons that makes no pair of far things."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR = 15.0
"""A point in no feature takes the one whose centre is nearest, if nearer than this."""
CELL = 64


def object_at_point(points: DataFrame, rings: DataFrame, near: float = NEAR, cell: int = CELL) -> DataFrame:
    """``(point_id, feature, inside)``: the first feature in which each of ``points(point_id, scene_id, x, y)`` lies, or else the nearest.

    ``rings(scene_id, feature, seq, x, y)`` are the vertices of one ring for each feature, in order; the last is joined to the first. A
    point is inside if a ray to the right crosses the ring an odd number of times (an edge owns its lower end but not its
    upper one). The centre of a feature is the mean of its vertices, as many as there are rows; of equally near ones the first
    feature counts. Without either, feature is null. Null coordinates are nowhere. Point ids are unique.

    Equal points are asked once, and of features of one scene with equal rings the first stands for all: it is first wherever they are hit or
    near. So pairs grow with different places and shapes, not with copies of them. Boxes of features are dealt to cells, where they meet points; edges are dealt to bands of y, where they meet the
    points of their own feature's candidates.
    """
    points = points.select("point_id", "scene_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    place = ["scene_id", "px", "py"]
    there = points.where("px is not null and py is not null and scene_id is not null").select(*place).distinct()
    rings = rings.select("scene_id", "feature", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    corners = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    shapes = rings.groupBy("scene_id", "feature").agg(corners.alias("shape")).groupBy("scene_id", "shape").agg(F.min("feature").alias("feature"))
    rings = shapes.select("scene_id", "feature", F.posexplode("shape").alias("seq", "p")).select("scene_id", "feature", "seq", "p.x", "p.y")
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    box = rings.groupBy("scene_id", "feature").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dealt = box.select("scene_id", "feature", "x0", "x1", "y0", "y1", cells("x0", "x1").alias("cell_x")).select("*", cells("y0", "y1").alias("cell_y"))
    at = there.select("*", F.floor(F.col("px") / cell).alias("cell_x"), F.floor(F.col("py") / cell).alias("cell_y"))
    asked = at.join(dealt, ["scene_id", "cell_x", "cell_y"]).where("px between x0 and x1 and py between y0 and y1").select(*place, "feature", F.col("cell_y").alias("band"))
    ring = Window.partitionBy("scene_id", "feature").orderBy("seq")
    first = Window.partitionBy("scene_id", "feature").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = rings.select("scene_id", "feature", "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("u"), F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("v"))
    edges = edges.where("y <> v").withColumns({"low": F.least("y", "v"), "high": F.greatest("y", "v")}).select("*", cells("low", "high").alias("band"))
    crossed = ((F.col("y") > F.col("py")) != (F.col("v") > F.col("py"))) & (F.col("px") < (F.col("u") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("v") - F.col("y")) + F.col("x"))
    inside = asked.join(edges, ["scene_id", "feature", "band"]).where(crossed).groupBy(*place, "feature").agg(F.count("*").alias("n")).where("n % 2 = 1")
    inside = inside.groupBy(*place).agg(F.min("feature").alias("hit"))
    side = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    reach = lambda c: F.floor(F.col(c) / near)
    centres = box.select("scene_id", F.col("feature").alias("close"), "cx", "cy", reach("cx").alias("cell_x"), reach("cy").alias("cell_y"))
    looking = there.join(inside, place, "left_anti").select("*", side.alias("a")).select("*", side.alias("b")).select(*place, (reach("px") + F.col("a")).alias("cell_x"), (reach("py") + F.col("b")).alias("cell_y"))
    far = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    closest = looking.join(centres, ["scene_id", "cell_x", "cell_y"]).withColumn("far", far).where(F.col("far") < near).groupBy(*place).agg(F.min(F.struct("far", "close")).alias("c"))
    found = inside.select(*place, "hit", F.lit(None).alias("c")).unionByName(closest.select(*place, F.lit(None).alias("hit"), "c"))
    out = points.join(found, place, "left")
    return out.select("point_id", F.coalesce("hit", "c.close").alias("feature"), F.col("hit").isNotNull().alias("inside"))
