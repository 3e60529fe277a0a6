"""Neighbourhood operators by window frames over rows and columns; slope, step and roughness by chunks.

Frames are partitioned by (scene, row) or (scene, col), so a scene of any size is dealt out by its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators import halo


def _lines(along: str):
    across = "row" if along == "col" else "col"
    return Window.partitionBy("scene_id", across).orderBy(along)


def gradient(px: DataFrame, z: str = "z") -> DataFrame:
    """``gy`` and ``gx``: central differences, one-sided at the ends of a line; a line of one pixel gives 0."""
    out = px
    for name, along in (("gy", "row"), ("gx", "col")):
        w = _lines(along)
        before, after = F.lag(z).over(w), F.lead(z).over(w)
        has_before, has_after = F.lag(F.lit(1)).over(w).isNotNull(), F.lead(F.lit(1)).over(w).isNotNull()
        out = out.withColumn(name, F.when(has_before & has_after, (after - before) / 2).when(has_after, after - F.col(z)).when(has_before, F.col(z) - before).otherwise(0.0))
    return out


def slope_deg(px: DataFrame, gsd: float, chunk: int = halo.CHUNK) -> DataFrame:
    """``(scene_id, row, col, slope)``; ``halo.terrain`` gives slope, step and roughness at once."""
    return halo.terrain(px, gsd, chunk).drop("step", "rough")


def step_height(px: DataFrame, chunk: int = halo.CHUNK) -> DataFrame:
    """``(scene_id, row, col, step)``: largest less smallest value of the 3 x 3 neighbourhood; repeating the border does not change either."""
    return halo.terrain(px, 1.0, chunk).drop("slope", "rough")


def roughness(px: DataFrame, chunk: int = halo.CHUNK) -> DataFrame:
    """``(scene_id, row, col, rough)``: standard deviation of the 5 x 5 window with the border repeated; heights must be finite."""
    return halo.terrain(px, 1.0, chunk).drop("slope", "step")


def _extreme(px: DataFrame, column: str, name: str, fn, before: int, after: int) -> DataFrame:
    first = px.withColumn(name, fn(column).over(_lines("col").rowsBetween(-before, after)))
    return first.withColumn(name, fn(name).over(_lines("row").rowsBetween(-before, after)))


def local_maxima(px: DataFrame, z: str = "z", reach: int = 12, least: float | None = None) -> DataFrame:
    """Pixels that are the largest of the square window around them and at least ``least``; equal ones all stay."""
    top = _extreme(px, z, "top", F.max, reach, reach).where(F.col(z) == F.col("top")).drop("top")
    return top if least is None else top.where(F.col(z) >= least)


def dilate(mask: DataFrame, rounds: int = 1) -> DataFrame:
    """3 x 3 dilation, outside counts as empty."""
    return _extreme(mask, "m", "m", F.max, rounds, rounds)


def erode(mask: DataFrame, height: int, width: int, rounds: int = 1) -> DataFrame:
    """3 x 3 erosion, outside counts as empty: pixels nearer to the border than ``rounds`` go."""
    inner = F.col("row").between(rounds, height - 1 - rounds) & F.col("col").between(rounds, width - 1 - rounds)
    return _extreme(mask, "m", "m", F.min, rounds, rounds).withColumn("m", F.when(inner, F.col("m")).otherwise(0))


def closing(mask: DataFrame, height: int, width: int, rounds: int = 1) -> DataFrame:
    return erode(dilate(mask, rounds), height, width, rounds)


def opening(mask: DataFrame, height: int, width: int, rounds: int = 1) -> DataFrame:
    return dilate(erode(mask, height, width, rounds), rounds)


def class_edges(px: DataFrame) -> DataFrame:
    """``m`` is 1 where a right, left, upper or lower neighbour has another class."""
    edge = F.lit(False)
    for along in ("row", "col"):
        w = _lines(along)
        for other in (F.lag("cls").over(w), F.lead("cls").over(w)):
            edge = edge | F.coalesce(other != F.col("cls"), F.lit(False))
    return px.withColumn("m", edge.cast("int"))


def dilate4(mask: DataFrame, rounds: int = 1, m: str = "m") -> DataFrame:
    """Dilation over the four neighbours: after n rounds all pixels within n steps."""
    for _ in range(rounds):
        for name, along in ((f"{m}_r", "row"), (f"{m}_c", "col")):
            w = _lines(along)
            mask = mask.withColumn(name, F.greatest(F.col(m), F.coalesce(F.lag(m).over(w), F.lit(0)), F.coalesce(F.lead(m).over(w), F.lit(0))))
        mask = mask.withColumn(m, F.greatest(f"{m}_r", f"{m}_c")).drop(f"{m}_r", f"{m}_c")
    return mask


def _touching(px: DataFrame, cls: int, name: str) -> DataFrame:
    """``name`` is 1 where one of the four neighbours has the class."""
    near = F.lit(0)
    for along in ("row", "col"):
        w = _lines(along)
        for other in (F.lag("cls").over(w), F.lead("cls").over(w)):
            near = F.greatest(near, F.coalesce((other == cls).cast("int"), F.lit(0)))
    return px.withColumn(name, near)


def boundary_bands(px: DataFrame, building: int, other: int, band: int = 2) -> DataFrame:
    """``px`` with three marks: within ``band`` steps of any class edge, of an edge that touches a building, and of both that and pixels that touch ``other``."""
    out = _touching(_touching(class_edges(px), building, "by_building"), other, "by_other")
    out = out.withColumn("edge_b", F.col("m") * F.col("by_building"))
    for c in ("m", "edge_b", "by_other"):
        out = dilate4(out, band, c)
    out = out.select(*px.columns, (F.col("m") == 1).alias("any_band"), (F.col("edge_b") == 1).alias("building_band"), ((F.col("edge_b") == 1) & (F.col("by_other") == 1)).alias("building_other"))
    return out


def offsets(px: DataFrame, radius: int) -> DataFrame:
    """Each pixel sent to the centres of the windows that hold it: (scene_id, row, col) is the centre, dr and dc the offset of the value."""
    steps = F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)))
    sent = px.select("scene_id", "row", "col", "z", F.explode(steps).alias("o"))
    return sent.select("scene_id", (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o.dr", "o.dc", "z")


def median_mad(px: DataFrame, radius: int = 1) -> DataFrame:
    """Median of the valid values in a window cut off at the border, and the median distance from it."""
    near = offsets(px, radius).join(px.select("scene_id", "row", "col"), ["scene_id", "row", "col"], "left_semi")
    near = near.where(~F.isnan("z") & F.col("z").isNotNull())
    keys = ["scene_id", "row", "col"]
    lists = near.groupBy(*keys).agg(F.array_sort(F.collect_list("z")).alias("v"))  # at most (2r+1)^2 values
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2 + 1).cast("int"))) / 2
    med = lists.withColumn("median", middle(F.col("v")))
    far = med.withColumn("far", F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("median")))))
    return px.join(far.select(*keys, "median", middle(F.col("far")).alias("mad")), keys, "left")


def block_mean(px: DataFrame, factor: int, height: int, width: int) -> DataFrame:
    """Mean of whole blocks; the ragged rest is left out."""
    whole = px.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    return whole.groupBy("scene_id", F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg("z").alias("z"))


def seam_error(px: DataFrame, tile: int) -> DataFrame:
    """Mean over seams (columns and rows at multiples of ``tile``) of the mean jump across."""
    parts = []
    for along in ("col", "row"):
        jump = F.abs(F.col("z") - F.lag("z").over(_lines(along)))
        seams = px.withColumn("jump", jump).where((F.col(along) % tile == 0) & (F.col(along) > 0) & F.col("jump").isNotNull())
        parts.append(seams.groupBy("scene_id", F.lit(along).alias("way"), F.col(along).alias("at")).agg(F.avg("jump").alias("jump")))
    return parts[0].unionByName(parts[1]).groupBy("scene_id").agg(F.avg("jump").alias("seam_error"), F.count("*").alias("n_seams"))
