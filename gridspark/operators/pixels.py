"""Maps over pixels: masks, cleaning, normalising, stretching, class legends, georeferencing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.rasters import clamp, finite, valid
from gridspark.operators.quantiles import percentiles

DEFAULT_NODATA = -9999.0


def invalid_mask(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """``px`` with is_nan, is_inf, is_nodata and invalid; a null value counts as NaN."""
    z = F.coalesce("z", F.lit(float("nan")))
    return px.select("*", F.isnan(z).alias("is_nan"), (F.abs(z) == float("inf")).alias("is_inf"), (z == nodata if nodata is not None else F.lit(False)).alias("is_nodata"), (~valid(z, nodata)).alias("invalid"))


def clean_dem(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Invalid values become the declared nodata, else -9999; valid ones stay."""
    fill = DEFAULT_NODATA if nodata is None else nodata
    return px.withColumn("z", F.when(valid(F.col("z"), nodata), F.col("z")).otherwise(fill))


def clean_agl(px: DataFrame) -> DataFrame:
    """Heights above ground: values that are not finite become 0, negative ones 0; ``target_ok`` marks finite inputs."""
    return px.select("*", F.greatest(F.when(finite(F.col("z")), F.col("z")).otherwise(0.0), F.lit(0.0)).alias("agl"), finite(F.col("z")).alias("target_ok"))


def per_scene(px: DataFrame, *aggregates) -> DataFrame:
    """Statistics of the valid pixels of each scene, one small row each."""
    return px.groupBy("scene_id").agg(*aggregates)


def minmax_tile(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Valid values scaled to [0, 1] by scene; a range under 1e-6 gives 0.5, an invalid value null."""
    ok = valid(F.col("z"), nodata)
    v = F.when(ok, F.col("z"))
    stats = per_scene(px, F.min(v).alias("lo"), F.max(v).alias("hi"))
    return px.join(stats, "scene_id").select(*px.columns, F.when(ok, F.when(F.col("hi") - F.col("lo") < 1e-6, 0.5).otherwise((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)))).alias("dn"))


def tile_stats4(px: DataFrame, nodata: float | None = None, eps: float = 1e-3) -> DataFrame:
    """Logarithms of low, high, range and mean of each scene; negative sums are taken as 0 before the logarithm."""
    v = F.when(valid(F.col("z"), nodata), F.col("z"))
    log = lambda x: F.ln(F.greatest(x, F.lit(0.0)) + eps)
    return per_scene(px, log(F.min(v)).alias("ln_lo"), log(F.max(v)).alias("ln_hi"), log(F.max(v) - F.min(v)).alias("ln_range"), log(F.avg(v)).alias("ln_mean"))


def normalize_dem(px: DataFrame, method: str = "minmax", nodata: float | None = None, sentinel: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """Pixels with ``norm`` by the scene's min-max or z-score (population), and the table of parameters; no range gives null."""
    v = F.when(valid(F.col("z"), nodata), F.col("z"))
    shift, scale = (F.min(v), F.max(v) - F.min(v)) if method == "minmax" else (F.avg(v), F.stddev_pop(v))
    params = per_scene(px, shift.alias("shift"), scale.alias("scale"))
    norm = F.when(valid(F.col("z"), nodata), F.try_divide(F.col("z") - F.col("shift"), F.col("scale"))).otherwise(sentinel)
    return px.join(params, "scene_id").select(*px.columns, norm.alias("norm")), params


def denormalize(norm: DataFrame, params: DataFrame, sentinel: float = -1.0) -> DataFrame:
    return norm.join(params, "scene_id").select(*norm.columns, F.when(F.col("norm") != sentinel, F.col("norm") * F.col("scale") + F.col("shift")).alias("restored"))


def stretch_to_01(px: DataFrame, low: float = 0.02, high: float = 0.98, nodata: float | None = None, flat: float = 0.5, fill: float | None = None) -> DataFrame:
    """Valid values stretched between two exact percentiles of the scene and clipped to [0, 1]; a flat scene gives ``flat``, an invalid value ``fill``."""
    ok = valid(F.col("z"), nodata)
    p = percentiles(px.where(ok), ["scene_id"], "z", [low, high]).select("scene_id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    unit = F.when(F.col("hi") > F.col("lo"), clamp(F.try_divide(F.col("z") - F.col("lo"), F.col("hi") - F.col("lo")), 0.0, 1.0)).otherwise(flat)
    return px.join(p, "scene_id", "left").select(*px.columns, F.when(ok, unit).otherwise(fill).alias("unit"))


def quantize(unit: F.Column, steps: int = 255) -> F.Column:
    """[0, 1] in whole steps, halves to even."""
    return F.rint(unit * steps).cast("int")


def encode_u16(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Heights over the scene's range in 65,535 steps; no range gives the middle."""
    ok = valid(F.col("z"), nodata)
    v = F.when(ok, F.col("z"))
    stats = per_scene(px, F.min(v).alias("lo"), F.max(v).alias("hi"))
    unit = F.when(F.col("hi") > F.col("lo"), F.try_divide(F.col("z") - F.col("lo"), F.col("hi") - F.col("lo"))).otherwise(0.5)
    return px.join(stats, "scene_id").select(*px.columns, F.when(ok, quantize(unit, 65535)).alias("u16"))


def luma(r: F.Column, g: F.Column, b: F.Column) -> F.Column:
    """Grey value in [0, 1] of 8-bit colours."""
    return (r * 0.299 + g * 0.587 + b * 0.114) / 255


def affine_predict(dn: F.Column, a: float, b: float, floor_zero: bool = False) -> F.Column:
    h = dn * a + b
    return F.greatest(h, F.lit(0.0)) if floor_zero else h


def map_classes(px: DataFrame, legend: DataFrame, ignore: int = 255) -> tuple[DataFrame, DataFrame]:
    """``project_cls`` by ``legend(cls, project_cls)``, and the class ids that the legend lacks. Legends are small fixed tables."""
    mapped = px.join(F.broadcast(legend), "cls", "left").withColumn("project_cls", F.coalesce("project_cls", F.lit(ignore)))
    return mapped, px.select("cls").distinct().join(F.broadcast(legend), "cls", "left_anti")


def probs_to_labels(probs: F.Column) -> tuple[F.Column, F.Column]:
    """Class of the largest probability (the first of equals) and that probability, after clipping at 0 and renormalising."""
    clipped = F.transform(probs, lambda p: F.greatest(p.cast("double"), F.lit(0.0)))
    total = F.greatest(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x), F.lit(1e-8))
    share = F.transform(clipped, lambda p: p / total)
    return (F.array_position(share, F.array_max(share)) - 1).cast("int"), F.array_max(share)


def softmax(logits: F.Column) -> F.Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def pixel_to_world(row: F.Column, col: F.Column, x0: F.Column, y0: F.Column, res: F.Column, centre: bool = False) -> tuple[F.Column, F.Column]:
    """World coordinates of a pixel's corner or centre on a north-up grid."""
    half = 0.5 if centre else 0.0
    return x0 + (col + half) * res, y0 - (row + half) * res


def flip_rotate(px: DataFrame, kind: str, height: int, width: int) -> DataFrame:
    """hflip, vflip, rot180 or rot90 (counter-clockwise) by coordinate arithmetic."""
    r, c = F.col("row"), F.col("col")
    to = {"hflip": (r, width - 1 - c), "vflip": (height - 1 - r, c), "rot180": (height - 1 - r, width - 1 - c), "rot90": (width - 1 - c, r)}[kind]
    return px.withColumns({"row": to[0].cast("int"), "col": to[1].cast("int")})


def stride_sample(px: DataFrame, step: int) -> DataFrame:
    return px.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def crop(px: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """A window with its own origin; an empty window is refused."""
    if min(row0, col0) < 0 or min(height, width) < 1:
        raise ValueError("window is empty or out of range")
    inside = px.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
    return inside.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def soft_cost(slope: F.Column, step: F.Column, max_slope: float, max_step: float, cls: F.Column) -> F.Column:
    """Cost of entering a cell from its slope and step: half as much again on cautious cells (1), prohibitive on blocked ones (2)."""
    base = 1 + 4 * F.pow(slope / max_slope, 2) + 3 * F.pow(step / max_step, 2)
    return F.when(cls == 2, 1e9).when(cls == 1, base * 1.5).otherwise(base)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ring_area(ring: F.Column) -> F.Column:
    """Shoelace area of an array of (x, y) structs."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)) / 2


def running_index(px: DataFrame, step: int) -> DataFrame:
    """Every step-th valid pixel of each scene in row-major order.

    Ranks are counted row by row and offset by the counts of earlier rows, so a scene of any size is dealt out.
    """
    ok = px.where(finite(F.col("z")))
    counts = ok.groupBy("scene_id", "row").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scene_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("scene_id", "row", before.alias("before"))
    at = F.row_number().over(Window.partitionBy("scene_id", "row").orderBy("col")) - 1
    return ok.withColumn("at", at).join(counts, ["scene_id", "row"]).where((F.col("at") + F.col("before")) % step == 0).drop("at", "before")
