"""Planes fitted robustly to all objects at once: each round is one pass with nine sums an object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite
from gridspark.operators.components import KEYS, LABEL
from gridspark.operators.quantiles import percentiles
from gridspark.plans.lineage import cut

LEAST_AREA, MAX_RESIDUAL, LEAST_INLIERS, TOLERANCE, ROUNDS = 400, 1.5, 0.6, 1.0, 4  # fixed values


def _fit(px: DataFrame) -> DataFrame:
    """``(*label, a, b, c)``: least squares of ``z = a x + b y + c`` over ``px(*label, x, y, z, w)``, residuals times w.

    Pixels on one line leave the slope across it free: it is 0.
    """
    w = F.col("w") * F.col("w")
    terms = {"x": F.col("x"), "y": F.col("y"), "z": F.col("z"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"), "xz": F.col("x") * F.col("z"), "yz": F.col("y") * F.col("z")}
    m = px.groupBy(*LABEL).agg(F.sum(w).alias("w"), *(F.sum(w * t).alias(k) for k, t in terms.items())).select(*LABEL, *((F.col(k) / F.col("w")).alias(k) for k in terms))
    m = m.select(*LABEL, "x", "y", "z", *((F.col(a + b) - F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xz", "yz")))
    xx, xy, yy, xz, yz = (F.col(k) for k in ("xx", "xy", "yy", "xz", "yz"))
    det, trace = xx * yy - xy * xy, xx + yy
    line = F.coalesce(F.try_divide(F.lit(1.0), trace * trace), F.lit(0.0))
    slope = lambda whole, flat: F.when(det > 1e-12 * trace * trace, F.try_divide(whole, det)).otherwise(flat * line)
    m = m.select(*LABEL, "x", "y", "z", slope(xz * yy - yz * xy, xx * xz + xy * yz).alias("a"), slope(yz * xx - xz * xy, xy * xz + yy * yz).alias("b"))
    return m.select(*LABEL, "a", "b", (F.col("z") - F.col("a") * F.col("x") - F.col("b") * F.col("y")).alias("c"))


def planar_refine(px: DataFrame, labels: DataFrame, least: int = LEAST_AREA, max_residual: float = MAX_RESIDUAL, least_inliers: float = LEAST_INLIERS, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``px`` with the heights of objects near their plane put on it, and ``(*label, area, status, rmse, inliers)`` of every object.

    ``labels`` holds the pixels of objects; those without a finite height do not count. Planes are fitted by least squares, then ``rounds`` times
    with weights by Huber's rule: 1 up to 1.345 scaled deviations (MAD of the residuals), less beyond. A pixel within ``tolerance`` of the plane is an inlier. An object is
    ``too_small`` below ``least`` pixels, ``rejected_residual`` if the inliers' rmse is over ``max_residual`` or there are none, ``rejected_inliers`` if they are less
    than ``least_inliers`` of it, else ``accepted``; only inliers of accepted ones change.
    """
    own = labels.join(px.where(finite(F.col("z"))).select(*KEYS, F.col("z").cast("double").alias("z")), KEYS)
    sizes = cut(own.groupBy(*LABEL).agg(F.count("*").alias("area"), F.avg("col").alias("cx"), F.avg("row").alias("cy")))
    large = sizes.where(F.col("area") >= least)
    pix = cut(own.join(large, LABEL).select(*KEYS, *LABEL[1:], "z", (F.col("col") - F.col("cx")).alias("x"), (F.col("row") - F.col("cy")).alias("y")))
    coef = cut(_fit(pix.withColumn("w", F.lit(1.0))))
    plane = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")
    for _ in range(rounds):
        left = pix.join(coef, LABEL).withColumn("r", F.col("z") - plane)
        middle = cut(percentiles(left, LABEL, "r", [0.5]).select(*LABEL, F.col("p")[0].alias("middle")))
        mad = percentiles(left.join(middle, LABEL).withColumn("far", F.abs(F.col("r") - F.col("middle"))), LABEL, "far", [0.5])
        scale = mad.select(*LABEL, F.greatest(1.4826 * F.col("p")[0] + 1e-6, F.lit(1e-3)).alias("s"))
        ar = F.abs("r") / (1.345 * F.col("s"))
        coef = cut(_fit(left.join(scale, LABEL).select(*LABEL, "x", "y", "z", F.when(ar <= 1, 1.0).otherwise(1 / ar).alias("w"))))
    near = F.abs(F.col("z") - F.col("plane")) <= tolerance
    fitted = pix.join(coef, LABEL).select(*KEYS, *LABEL[1:], "z", plane.alias("plane"))
    sq = F.when(near, (F.col("z") - F.col("plane")) ** 2)
    told = fitted.groupBy(*LABEL).agg(F.sqrt(F.avg(sq)).alias("rmse"), F.count_if(near).alias("inliers"))
    status = F.when(F.col("area") < least, "too_small").when(F.col("rmse").isNull() | (F.col("rmse") > max_residual), "rejected_residual").when(F.col("inliers") / F.col("area") < least_inliers, "rejected_inliers").otherwise("accepted")
    verdict = cut(sizes.join(told, LABEL, "left").select(*LABEL, "area", status.alias("status"), "rmse", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers")))
    flat = fitted.where(near).join(verdict.where("status = 'accepted'").select(*LABEL), LABEL, "left_semi").select(*KEYS, "plane")
    return px.join(flat, KEYS, "left").withColumn("z", F.coalesce("plane", "z")).drop("plane"), verdict
