"""Values, classes and slopes at fractional places of a scene, and measurements between points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["scene_id", "row", "col"]


def sample_bilinear(points: DataFrame, px: DataFrame, height: int, width: int) -> DataFrame:
    """Values at ``points(point_id, scene_id, u, v)`` with u and v in [0, 1] over the scene's first to last pixel; beyond the edge the border counts."""
    x = F.least(F.greatest(F.col("u"), F.lit(0.0)), F.lit(1.0)) * (width - 1)
    y = F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0)) * (height - 1)
    at = points.select("point_id", "scene_id", x.alias("x"), y.alias("y"), F.floor(x).alias("c"), F.floor(y).alias("r"))
    taps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    asked = at.select("*", F.explode(taps).alias("o"))
    weight = F.when(F.col("o.i") == 1, F.col("y") - F.col("r")).otherwise(1 - (F.col("y") - F.col("r"))) * F.when(F.col("o.j") == 1, F.col("x") - F.col("c")).otherwise(1 - (F.col("x") - F.col("c")))
    asked = asked.select("point_id", "scene_id", F.least(F.col("r") + F.col("o.i"), F.lit(height - 1)).cast("int").alias("row"), F.least(F.col("c") + F.col("o.j"), F.lit(width - 1)).cast("int").alias("col"), weight.alias("w"))
    return asked.join(px.select(*KEYS, "z"), KEYS).groupBy("point_id").agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def sample_class(points: DataFrame, px: DataFrame, height: int, width: int) -> DataFrame:
    """Class of the nearest pixel and its confidence; where that is unknown, the scene's mean."""
    mean = px.groupBy("scene_id").agg(F.avg("conf").alias("mean_conf"))
    side = lambda c, n: F.least(F.greatest(F.floor(F.col(c) * (n - 1) + 0.5), F.lit(0)), F.lit(n - 1)).cast("int")
    at = points.select("point_id", "scene_id", side("v", height).alias("row"), side("u", width).alias("col"))
    return at.join(px.select(*KEYS, "cls", "conf"), KEYS, "left").join(mean, "scene_id", "left").select("point_id", "cls", F.coalesce("conf", "mean_conf").alias("conf"))


def sample_slope(points: DataFrame, px: DataFrame, height: int, width: int, gsd: float) -> DataFrame:
    """Slope in degrees and the unit normal at each point, from values one pixel to each side."""
    du, dv = 1 / (width - 1), 1 / (height - 1)
    near = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a * du).alias("du"), F.lit(b * dv).alias("dv")) for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])))
    asked = points.select(F.col("point_id").alias("p"), "scene_id", "u", "v", F.explode(near).alias("o"))
    asked = asked.select(F.struct("p", "o.k").alias("point_id"), "scene_id", (F.col("u") + F.col("o.du")).alias("u"), (F.col("v") + F.col("o.dv")).alias("v"))
    z = sample_bilinear(asked, px, height, width).select("point_id.p", "point_id.k", "z")
    four = z.groupBy("p").agg(*(F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)))
    gx, gy = (F.col("z0") - F.col("z1")) / (2 * gsd), (F.col("z2") - F.col("z3")) / (2 * gsd)
    length = F.sqrt(gx * gx + gy * gy + 1)
    return four.select(F.col("p").alias("point_id"), F.degrees(F.atan(F.hypot(gx, gy))).alias("slope"), (-gx / length).alias("nx"), (-gy / length).alias("ny"), (1 / length).alias("nz"))


def measure(pairs: DataFrame, px: DataFrame) -> DataFrame:
    """Rise, distance and slope between the two points of ``pairs(pair_id, scene_id, r1, c1, r2, c2, gsd)``.

    Without a ground distance there is no slope and the distance is in pixels. Equal points and points without a value are errors.
    """
    side = lambda r, c, name: px.select("scene_id", F.col("row").alias(r), F.col("col").alias(c), F.when(~F.isnan("z"), F.col("z")).alias(name))
    both = pairs.join(side("r1", "c1", "z1"), ["scene_id", "r1", "c1"], "left").join(side("r2", "c2", "z2"), ["scene_id", "r2", "c2"], "left")
    flat = F.hypot(F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1")) * F.coalesce("gsd", F.lit(1.0))
    rise = F.col("z2") - F.col("z1")
    status = F.when((F.col("r1") == F.col("r2")) & (F.col("c1") == F.col("c2")), "EQUAL_POINTS").when(rise.isNull(), "NO_DATA").otherwise("OK")
    ok = status == "OK"
    return both.select("pair_id", status.alias("status_code"), F.when(ok, rise).alias("rise"), F.when(ok, flat).alias("distance"), F.when(ok & F.col("gsd").isNotNull(), F.degrees(F.atan2(F.abs(rise), flat))).alias("slope_deg"))
