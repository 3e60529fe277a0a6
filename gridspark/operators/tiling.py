"""Tile windows, blending, stitching, pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def starts(extent: F.Column, size: int, stride: int) -> F.Column:
    """Window starts along an axis by stride; the last is moved in to end at the border; a short axis has one."""
    last = F.greatest(extent - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(stride).cast("int")), F.array(last.cast("int"))))


def tile_windows(scenes: DataFrame, size: int, overlap: int) -> DataFrame:
    """``(scene_id, ri, ci, row_off, col_off, valid_h, valid_w)`` from ``scenes(scene_id, height, width)``."""
    stride = size - overlap
    rows = scenes.select("scene_id", "height", "width", F.posexplode(starts(F.col("height"), size, stride)).alias("ri", "row_off"))
    cells = rows.select("*", F.posexplode(starts(F.col("width"), size, stride)).alias("ci", "col_off"))
    return cells.select("scene_id", "ri", "ci", "row_off", "col_off", F.least(F.lit(size), F.col("height") - F.col("row_off")).alias("valid_h"), F.least(F.lit(size), F.col("width") - F.col("col_off")).alias("valid_w"))


def tile_pixels(px: DataFrame, scenes: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each pixel in every window that covers it, with its place (i, j) there; the windows are told from the pixel's place."""
    stride = size - overlap
    sized = px.join(scenes.select("scene_id", "height", "width"), "scene_id")

    def covers(at: F.Column, extent: F.Column) -> F.Column:
        last = F.greatest(extent - size, F.lit(0))
        count = F.ceil(last / stride).cast("int")  # windows before the one moved in
        low = F.greatest(F.ceil((at - size + 1) / stride), F.lit(0)).cast("int")
        high = F.least(F.floor(at / stride).cast("int"), count - 1)
        whole = F.when(low <= high, F.transform(F.sequence(low, F.greatest(high, low)), lambda k: F.struct(k.cast("int").alias("k"), (k * stride).cast("int").alias("s")))).otherwise(F.array().cast("array<struct<k:int,s:int>>"))
        moved = F.when(at >= last, F.array(F.struct(count.alias("k"), last.cast("int").alias("s")))).otherwise(F.array().cast("array<struct<k:int,s:int>>"))
        return F.concat(whole, moved)

    rows = sized.select("*", F.explode(covers(F.col("row"), F.col("height"))).alias("wr"))
    both = rows.select("*", F.explode(covers(F.col("col"), F.col("width"))).alias("wc"))
    return both.select("scene_id", F.col("wr.k").alias("ri"), F.col("wc.k").alias("ci"), "row", "col", (F.col("row") - F.col("wr.s")).alias("i"), (F.col("col") - F.col("wc.s")).alias("j"), "z")


def blend_weight(i: F.Column, size: int, overlap: int) -> F.Column:
    """Half-cosine ramp over the overlap at both ends, at least 0.001."""
    taper = min(overlap, size // 2)
    if taper < 2:
        return F.lit(1.0)
    d = F.least(i, size - 1 - i)
    return F.greatest(F.when(d < taper, 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * d / (taper - 1))).otherwise(1.0), F.lit(1e-3))


def stitch(tiles: DataFrame, size: int, overlap: int) -> DataFrame:
    """Weighted mean of all windows over each pixel; NaN weighs nothing, a pixel without a value is NaN."""
    w = F.when(F.isnan("z"), 0.0).otherwise(blend_weight(F.col("i"), size, overlap) * blend_weight(F.col("j"), size, overlap))
    v = F.when(F.isnan("z"), 0.0).otherwise(F.col("z"))
    s = tiles.groupBy("scene_id", "row", "col").agg(F.sum(w * v).alias("wz"), F.sum(w).alias("w"))
    return s.select("scene_id", "row", "col", F.coalesce(F.try_divide("wz", "w"), F.lit(float("nan"))).alias("z"))


def tile_grid(scenes: DataFrame, size: int) -> DataFrame:
    """Cells of a grid without overlap, with the extent of those at the border."""
    cells = scenes.select("scene_id", "height", "width", F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / size).cast("int") - 1)).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / size).cast("int") - 1)).alias("tx"))
    return cells.select("scene_id", "ty", "tx", F.least(F.lit(size), F.col("height") - F.col("ty") * size).alias("h"), F.least(F.lit(size), F.col("width") - F.col("tx") * size).alias("w"))


def mosaic(px: DataFrame, scenes: DataFrame) -> DataFrame:
    """Mean of all scenes over a common grid with the corner of their union and the resolution of the first scene.

    Scenes have equal CRS and resolution; others are to be refused by ``mosaic_problems`` before.
    """
    frame = scenes.agg(F.min("x0").alias("gx"), F.max("y0").alias("gy"), F.min_by("res", "scene_id").alias("gres"))
    offset = scenes.crossJoin(F.broadcast(frame)).select("scene_id", F.rint((F.col("x0") - F.col("gx")) / F.col("gres")).cast("int").alias("dc"), F.rint((F.col("gy") - F.col("y0")) / F.col("gres")).cast("int").alias("dr"))  # one row
    ok = px.where(~F.isnan("z") & (F.col("z") != -9999))
    moved = ok.join(offset, "scene_id").select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "z")
    return moved.groupBy("row", "col").agg(F.avg("z").alias("z"), F.count("*").alias("n"))


def mosaic_problems(scenes: DataFrame) -> DataFrame:
    """Scenes whose CRS or resolution differs from that of the first one."""
    first = scenes.agg(F.min_by(F.struct("crs", "res"), "scene_id").alias("f"))
    out = scenes.crossJoin(F.broadcast(first))  # one row
    code = F.when(~F.col("crs").eqNullSafe(F.col("f.crs")), "CRS_MISMATCH").when(F.abs(F.col("res") - F.col("f.res")) > 1e-6 * F.col("f.res"), "RESOLUTION_MISMATCH")
    return out.select("scene_id", code.alias("status_code")).where("status_code is not null")


def quadtree_window(scenes: DataFrame, z: int) -> DataFrame:
    """Pixel windows of the tiles of a level: edges at the rounded (half to even) fractions of each axis, at least one pixel."""
    side = 1 << z
    cells = scenes.select("scene_id", "height", "width", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y"))
    cut = lambda k, extent: F.rint(k * F.col(extent) / side).cast("int")
    return cells.select("scene_id", F.lit(z).alias("z"), "x", "y", cut(F.col("y"), "height").alias("row0"), cut(F.col("x"), "width").alias("col0"), F.greatest(cut(F.col("y") + 1, "height") - cut(F.col("y"), "height"), F.lit(1)).alias("h"), F.greatest(cut(F.col("x") + 1, "width") - cut(F.col("x"), "width"), F.lit(1)).alias("w"))
