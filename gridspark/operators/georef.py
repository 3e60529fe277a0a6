"""Georeferencing: pixel sizes, windows, bounds, names, anchoring to elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0


def pixel_size_m(kind: F.Column, a: F.Column, e: F.Column, f: F.Column, unit: F.Column) -> tuple[F.Column, F.Column]:
    """Width and height of a pixel in metres.

    ``kind`` is geographic, projected or null; a geographic width shrinks with the cosine of latitude f, a projected
    size needs its linear unit. What is not known is null, never taken for 1.
    """
    known = kind.isNotNull() & (a != 0) & (e != 0)
    lon = F.abs(a) * METRES_PER_DEGREE * F.greatest(F.cos(F.radians(F.coalesce(f, F.lit(0.0)))), F.lit(0.0))
    pick = lambda degrees, metres: F.when(known & (kind == "geographic"), degrees).when(known & unit.isNotNull(), metres)
    return pick(lon, F.abs(a) * unit), pick(F.abs(e) * METRES_PER_DEGREE, F.abs(e) * unit)


def georeferenced(crs: F.Column, identity: F.Column) -> tuple[F.Column, F.Column]:
    """Whether a raster is georeferenced, and why."""
    reason = F.when(crs.isNotNull(), F.concat(F.lit("CRS present: "), crs)).when(~identity, "No CRS but non-identity transform").otherwise("No CRS, identity transform")
    return crs.isNotNull() | ~identity, reason


def window_bounds(x0: F.Column, y0: F.Column, res: F.Column, row: F.Column, col: F.Column, height: F.Column, width: F.Column) -> dict[str, F.Column]:
    """Corner of a window's transform and its bounds on a north-up grid."""
    west, north = x0 + col * res, y0 - row * res
    return {"west": west, "north": north, "east": west + width * res, "south": north - height * res}


def world_to_pixel(x: F.Column, y: F.Column, x0: F.Column, y0: F.Column, res: F.Column) -> tuple[F.Column, F.Column]:
    """Row and column of a place; the inverse of ``pixel_to_world``."""
    return F.floor((y0 - y) / res), F.floor((x - x0) / res)


def tile_name(row: F.Column, col: F.Column) -> F.Column:
    return F.format_string("tile_r%03d_c%03d", row.cast("int"), col.cast("int"))


def footprint_key(west: F.Column, south: F.Column, east: F.Column, north: F.Column, crs: F.Column) -> F.Column:
    """Eight hex digits that name a footprint: bounds at six places and the CRS (``None`` without one), between commas."""
    return F.substring(F.sha2(F.concat(F.format_string("%.6f,%.6f,%.6f,%.6f,", west, south, east, north), F.coalesce(crs, F.lit("None"))), 256), 1, 8)


def output_type(has_dem: F.Column, constant: F.Column) -> F.Column:
    """What heights mean: a DEM beats a constant, without either they are relative."""
    return F.when(has_dem, "absolute").when(constant.isNotNull() & ~F.isnan(constant) & (F.abs(constant) != float("inf")), "anchored-constant").otherwise("relative")


def anchor_constant(agl: DataFrame, constant: float) -> DataFrame:
    """Heights above ground on a constant datum, which must be finite."""
    if constant != constant or abs(constant) == float("inf"):
        raise ValueError("the datum must be finite")
    return agl.withColumn("dsm", F.col("z") + constant)


def anchor_dem(agl: DataFrame, dem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Surface = height above ground + elevation on equal pixels, and min, mean, max of the elevation by scene; a scene that the DEM does not cover whole is refused."""
    keys = ["scene_id", "row", "col"]
    joined = agl.join(dem.select(*keys, F.col("z").alias("ground")), keys, "left")
    stats = joined.groupBy("scene_id").agg(
        F.min("ground").alias("dem_min"), F.avg("ground").alias("dem_mean"), F.max("ground").alias("dem_max"), F.count_if(F.col("ground").isNull() | F.isnan("ground")).alias("uncovered")
    )
    stats = stats.select("*", F.when(F.col("uncovered") > 0, "DEM_COVERAGE_INSUFFICIENT").otherwise("OK").alias("status_code"))
    good = stats.where("uncovered = 0").select("scene_id")
    return joined.join(good, "scene_id", "left_semi").select(*keys, (F.col("z") + F.col("ground")).alias("dsm")), stats


def provenance(scenes: DataFrame, dem_crs: str | None) -> DataFrame:
    """Where each scene's heights come from; unknown parts are null."""
    return scenes.select("scene_id", F.struct(F.col("crs").alias("scene_crs"), F.lit(dem_crs).alias("dem_crs"), (F.col("crs") == F.lit(dem_crs)).alias("same_crs"), F.when(F.col("crs").isNotNull(), F.col("res")).alias("gsd_m")).alias("provenance"))


def elevation_confidence(stats: DataFrame) -> DataFrame:
    """``stats(scene_id, span, rmse, gsd_m)`` with percent, level and half a step of a 16-bit height map.

    A percentage is given only where a reference gave an RMSE; else georeferenced scenes are medium, others low.
    """
    percent = F.when(F.col("rmse").isNotNull() & (F.col("span") > 1e-6), F.rint(F.least(F.greatest(100 * (1 - F.col("rmse") / F.col("span")), F.lit(5.0)), F.lit(99.0))).cast("int"))
    level = F.when(percent >= 85, "high").when(percent >= 60, "medium").when(percent.isNotNull(), "low").when(F.col("gsd_m").isNotNull(), "medium").otherwise("low")
    return stats.select("scene_id", percent.alias("percent"), level.alias("level"), F.greatest(F.col("span") / 65535 / 2, F.lit(1e-4)).alias("precision_m"))
