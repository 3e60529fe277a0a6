"""Registered queries of smoothing by an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import refine, spikes, wls
from gridspark.plans.registry import EV, query
from gridspark.sources import fixtures as fx

CHUNK = 16
_IM = f"{EV}, k AS (SELECT s, r, c, CASE WHEN z = -9999 THEN 'nan'::DOUBLE ELSE z END AS z, (truth * 2) % 64 AS re, (truth * 3) % 64 + c AS gr, (truth * 5) % 64 + r AS bl FROM ev)"
_FAR = "((abs(a.re - b.re) + abs(a.gr - b.gr) + abs(a.bl - b.bl)) / 255)"


def _image(spark, d) -> DataFrame:
    t = F.col("truth")
    z = F.when(F.col("z") == fx.NODATA, float("nan")).otherwise(F.col("z"))
    return fx.pixels(spark, d).select("scene_id", "row", "col", z.alias("z"), (t * 2 % 64).alias("red"), (t * 3 % 64 + F.col("col")).alias("green"), (t * 5 % 64 + F.col("row")).alias("blue"))


@query(f"""WITH {_IM} SELECT a.s AS scene_id, a.r AS "row", a.c AS col, round(coalesce(max(exp(-({_FAR} ** 2) / 0.0625)) FILTER (b.c = a.c + 1), 0), 6) AS "right", round(coalesce(max(exp(-({_FAR} ** 2) / 0.0625)) FILTER (b.r = a.r + 1), 0), 6) AS down
FROM k a LEFT JOIN k b ON b.s = a.s AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)) AND NOT isnan(a.z) AND NOT isnan(b.z) GROUP BY ALL""")
def e17_edge_weights(spark, d):
    return refine.edge_weights(_image(spark, d), 0.25, CHUNK)


@query(f"""WITH {_IM}, p AS (SELECT a.s, a.r, a.c, b.z, exp(-({_FAR} ** 2) / (2 * 0.2 ** 2) - ((a.r - b.r) ** 2 + (a.c - b.c) ** 2) / (2 * 1.5 ** 2)) AS w FROM k a JOIN k b ON b.s = a.s AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE NOT isnan(b.z)),
v AS (SELECT s, r, c, CASE WHEN sum(w) > 1e-12 THEN sum(w * z) / sum(w) ELSE 0 END AS q FROM p GROUP BY ALL)
SELECT k.s AS scene_id, k.r AS "row", k.c AS col, CASE WHEN isnan(k.z) THEN 'nan'::DOUBLE ELSE round(q, 6) END AS q FROM k LEFT JOIN v USING (s, r, c)""")
def e07_joint_bilateral(spark, d):
    return refine.joint_bilateral(_image(spark, d), 3, 0.2, 1.5, CHUNK)


@query()
def e18_wls_refine(spark, d):
    """Heights of every scene smoothed by its image; compared with the dense equations in tests."""
    return wls.wls_refine(_image(spark, d), 4.0, 0.25, chunk=CHUNK)


@query()
def e10_remove_spikes(spark, d):
    """Heights of every scene without spikes and pits; compared with plain Python in tests."""
    return spikes.remove_spikes(_image(spark, d).select("scene_id", "row", "col", (F.when(F.col("red") > 61, 9.0).otherwise(0.0) + F.col("green") / 16 + F.col("z") * 0).alias("z")), chunk=CHUNK)
