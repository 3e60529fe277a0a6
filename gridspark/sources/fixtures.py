"""Rasters, metric pairs, footprints and job events derived from the given tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 40, 25
NODATA = -9999.0
# Class id of each event type.
CLASS_OF = {"click": 2, "error": 5, "purchase": 6, "signup": 9, "view": 65}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_of() -> F.Column:
    out = F.lit(None).cast("int")
    for name, i in CLASS_OF.items():
        out = F.when(F.col("event_type") == name, i).otherwise(out)
    return out


def pixels(spark: SparkSession, sf_dir: str, columns: int = WIDTH, per_scene: int | None = WIDTH * HEIGHT) -> DataFrame:
    """``(scene_id, row, col, z, truth, cls)``: events laid out row by row in scenes of ``per_scene`` pixels, or in one."""
    e = F.col("event_id")
    inside = e % per_scene if per_scene else e
    z = F.when(e % 37 == 0, F.lit(float("nan"))).when(e % 41 == 0, NODATA).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        (F.floor(e / per_scene) if per_scene else F.lit(0)).cast("long").alias("scene_id"),
        F.floor(inside / columns).cast("int").alias("row"),
        (inside % columns).cast("int").alias("col"),
        z.alias("z"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("truth"),
        class_of().alias("cls"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scene_id, width, height, crs, x0, y0, res, nodata)``: scenes touch their neighbours at half a metre; every fifth has no CRS."""
    ids = pixels(spark, sf_dir).select("scene_id").distinct()
    return ids.select(
        "scene_id",
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.when(F.col("scene_id") % 5 != 4, "EPSG:32632").alias("crs"),
        (F.col("scene_id") * 20 + 500000).cast("double").alias("x0"),
        F.lit(5600000.0).alias("y0"),
        F.lit(0.5).alias("res"),
        F.lit(NODATA).alias("nodata"),
    )


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tile, split, city, cls, pred, truth)`` from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tile"),
        F.col("l_returnflag").alias("split"),
        F.col("l_linestatus").alias("city"),
        F.col("l_linenumber").cast("int").alias("cls"),
        (F.col("l_extendedprice") / 1000).alias("pred"),
        F.col("l_quantity").alias("truth"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(job_id, scene_id, ts, status, event_id)``: a user's events as those of a job."""
    status = {"signup": "queued", "view": "processing", "click": "heartbeat", "purchase": "completed", "error": "failed"}
    pick = F.lit(None).cast("string")
    for k, v in status.items():
        pick = F.when(F.col("event_type") == k, v).otherwise(pick)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("user_id") % 20).alias("scene_id"), "ts", pick.alias("status"), "event_id")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, west, south, east, north)`` in degrees from supplier keys."""
    k = F.col("s_suppkey")
    west, south = (k * 37 % 3600) / 10.0 - 180, (k * 53 % 1600) / 10.0 - 80
    return table(spark, sf_dir, "supplier").select(k.alias("id"), west.alias("west"), south.alias("south"), (west + 0.3 + (k % 7) / 4.0).alias("east"), (south + 0.2 + (k % 5) / 4.0).alias("north"))
