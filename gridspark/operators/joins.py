"""Joins of rasters, footprints, points and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

KEYS = ["scene_id", "row", "col"]


def align(pred: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs on equal pixels, and scenes whose grids do not match (pixels without a partner)."""
    p, t = pred.select(*KEYS, F.col("z").alias("pred")), truth.select(*KEYS, F.col("z").alias("truth"))
    full = cut(p.withColumn("has_p", F.lit(1)).join(t.withColumn("has_t", F.lit(1)), KEYS, "full_outer"))  # both results read it
    lost = full.groupBy("scene_id").agg(F.count_if(F.col("has_p").isNull() | F.col("has_t").isNull()).alias("lost")).where("lost > 0")
    return full.where("has_p = 1 and has_t = 1").drop("has_p", "has_t"), lost.select("scene_id", F.lit("GRID_MISMATCH").alias("status_code"), "lost")


def resample_bilinear(px: DataFrame, target: DataFrame) -> DataFrame:
    """Values at fractional places: ``target(point_id, scene_id, v, u)`` in pixel centres; taps that are missing or NaN weigh nothing, no tap gives NaN. Point ids are unique.

    The four taps of a place are gathered on the side of the pixels, so a point is sent once and nothing is added up over points.
    """
    taps = [(i, j) for i in (0, 1) for j in (0, 1)]
    to = F.explode(F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in taps)))
    sent = px.where(~F.isnan("z")).select(*KEYS, "z", to.alias("o")).select("scene_id", (F.col("row") - F.col("o.di")).cast("long").alias("r"), (F.col("col") - F.col("o.dj")).cast("long").alias("c"), "o", "z")
    quads = sent.groupBy("scene_id", "r", "c").agg(*(F.max(F.when((F.col("o.di") == i) & (F.col("o.dj") == j), F.col("z"))).alias(f"z{i}{j}") for i, j in taps))
    r, c = F.floor("v"), F.floor("u")
    asked = target.select("point_id", "scene_id", r.alias("r"), c.alias("c"), (F.col("v") - r).alias("fv"), (F.col("u") - c).alias("fu"))
    hit = asked.join(quads, ["scene_id", "r", "c"], "left")
    share = lambda k, name: F.col(name) if k else 1 - F.col(name)
    w = {t: F.when(F.col(f"z{t[0]}{t[1]}").isNull(), 0.0).otherwise(share(t[0], "fv") * share(t[1], "fu")) for t in taps}
    wz = sum((F.when(w[t] > 0, w[t] * F.col(f"z{t[0]}{t[1]}")).otherwise(0.0) for t in taps), F.lit(0.0))
    return hit.select("point_id", F.coalesce(F.try_divide(wz, sum(w.values(), F.lit(0.0))), F.lit(float("nan"))).alias("z"))


def cover_cells(boxes: DataFrame) -> DataFrame:
    """One-degree cells that a box meets, named by their south-west corner."""
    lats = F.sequence(F.floor("south"), F.greatest(F.ceil("north") - 1, F.floor("south")))
    lons = F.sequence(F.floor("west"), F.greatest(F.ceil("east") - 1, F.floor("west")))
    cells = boxes.select("id", F.explode(lats).alias("lat"), lons.alias("lons")).select("id", "lat", F.explode("lons").alias("lon"))
    name = F.concat(F.when(F.col("lat") < 0, "S").otherwise("N"), F.lpad(F.abs("lat").cast("string"), 2, "0"), F.when(F.col("lon") < 0, "W").otherwise("E"), F.lpad(F.abs("lon").cast("string"), 3, "0"))
    return cells.select("id", "lat", "lon", name.alias("cell"))


def adjacency(boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs (a < b) of boxes that touch or overlap: an equi-join on coarse cells, then the exact test."""
    lats = F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))
    lons = F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell))
    dealt = boxes.select("id", "west", "south", "east", "north", F.explode(lats).alias("cy"), lons.alias("ls")).select("id", "west", "south", "east", "north", "cy", F.explode("ls").alias("cx"))
    b = dealt.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "west", "south", "east", "north")), "cy", "cx")
    meets = (F.col("west") <= F.col("b_east")) & (F.col("b_west") <= F.col("east")) & (F.col("south") <= F.col("b_north")) & (F.col("b_south") <= F.col("north"))
    return dealt.join(b, ["cy", "cx"]).where(meets & (F.col("id") < F.col("b_id"))).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()


def scattered(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Boxes without any neighbour."""
    near = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    return boxes.join(near, "id", "left_anti").select("id")


def zonal(objects: DataFrame, px: DataFrame) -> DataFrame:
    """Count, mean, low and high of valid pixels under each object; ``objects(scene_id, row, col, object_id)``."""
    ok = px.where(~F.isnan("z") & (F.col("z") != -9999))
    return objects.join(ok, KEYS).groupBy("object_id").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("lo"), F.max("z").alias("hi"))


def sample_points(points: DataFrame, px: DataFrame, height: int, width: int) -> DataFrame:
    """Pixel under each of ``points(point_id, scene_id, row, col)``: ok, no_data or out_of_grid."""
    hit = points.join(px.select(*KEYS, "z"), KEYS, "left")
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    bad = F.col("z").isNull() | F.isnan("z") | (F.col("z") == -9999)
    return hit.select("point_id", F.when(~inside, "out_of_grid").when(bad, "no_data").otherwise("ok").alias("status"), F.when(inside & ~bad, F.col("z")).alias("z"))


def pick_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def missing_from(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")
