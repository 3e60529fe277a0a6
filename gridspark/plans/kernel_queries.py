"""Registered queries of halo kernels, components and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import components, halo
from gridspark.plans.map_queries import RC
from gridspark.plans.registry import _CL, _SLOPE, EV, _smooth, query
from gridspark.sources import fixtures as fx

CHUNK = 16
"""Chunks smaller than the fixture's scenes, so halos and borders of chunks count."""


def _holes(spark, d) -> DataFrame:
    """Heights with NaN where they are not valid."""
    z = F.when(F.col("z") == fx.NODATA, float("nan")).otherwise(F.col("z"))
    return fx.pixels(spark, d).select("scene_id", "row", "col", z.alias("z"), (F.col("truth") / 100).alias("guide"))


_H = f"{EV}, k AS (SELECT s, r, c, CASE WHEN z = -9999 THEN 'nan'::DOUBLE ELSE z END AS z FROM ev)"
_R3 = "(SELECT unnest(range(-3, 4)) AS d) y, (SELECT unnest(range(-3, 4)) AS d) x"


@query(f"""WITH {_H}, o AS (SELECT a.s, a.r, a.c, greatest(0, least(24, a.r + y.d)) AS nr, greatest(0, least(39, a.c + x.d)) AS nc FROM k a, {_R3})
SELECT o.s AS scene_id, o.r AS "row", o.c AS col, round(coalesce(avg(b.z) FILTER (NOT isnan(b.z)), 0), 6) AS mean FROM o JOIN k b ON b.s = o.s AND b.r = o.nr AND b.c = o.nc GROUP BY ALL""")
def e05_box_mean(spark, d):
    return halo.box_mean(_holes(spark, d), 3, CHUNK)


@query()
def e06_guided_filter(spark, d):
    return halo.guided_filter(_holes(spark, d), 4, 1e-3)


@query(f"""WITH {_H}, v AS (SELECT a.s, a.r, a.c, list(b.z) FILTER (NOT isnan(b.z)) AS zs FROM k a JOIN k b ON a.s = b.s AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.s, a.r, a.c)
SELECT {RC}, round(coalesce(list_median(zs), 'nan'::DOUBLE), 6) AS median FROM v""")
def e09_median_filter(spark, d):
    return halo.median_filter(_holes(spark, d), 3, CHUNK)


@query()
def e11_fill_invalid(spark, d):
    return halo.fill_invalid(_holes(spark, d).withColumn("z", F.when((F.col("row") % 11 < 7) & (F.col("col") % 13 < 9), float("nan")).otherwise(F.col("z"))))


_G = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-3, 4), (lambda g: [x / sum(g) for x in g])([2.718281828459045 ** (-(i * i) / 2.0) for i in range(-3, 4)])))


@query(f"""WITH {_CL}, w(d, g) AS (VALUES {_G}), v AS (SELECT a.s, a.r, a.c, sum(g * b.z) AS z FROM k a, w JOIN k b ON b.s = a.s AND b.c = a.c AND b.r = CASE WHEN a.r + d < 0 THEN -1 - a.r - d WHEN a.r + d > 24 THEN 49 - a.r - d ELSE a.r + d END GROUP BY ALL)
SELECT a.s AS scene_id, a.r AS "row", a.c AS col, round(sum(g * b.z), 6) AS blur FROM v a, w JOIN v b ON b.s = a.s AND b.r = a.r AND b.c = CASE WHEN a.c + d < 0 THEN -1 - a.c - d WHEN a.c + d > 39 THEN 79 - a.c - d ELSE a.c + d END GROUP BY ALL""")
def e14_gaussian_blur(spark, d):
    return halo.gaussian_blur(_smooth(spark, d), 1.0, CHUNK)


@query()
def e22_ground_surface(spark, d):
    return halo.ground_surface(_holes(spark, d), 12)


@query(f"""WITH {_SLOPE}, st AS (SELECT a.s, a.r, a.c, max(b.z) - min(b.z) AS step FROM k a JOIN k b ON a.s = b.s AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.s, a.r, a.c),
o AS (SELECT a.s, a.r, a.c, greatest(0, least(24, a.r + y.d)) AS nr, greatest(0, least(39, a.c + x.d)) AS nc FROM k a, (SELECT unnest(range(-2, 3)) AS d) y, (SELECT unnest(range(-2, 3)) AS d) x),
ro AS (SELECT o.s, o.r, o.c, stddev_pop(b.z) AS rough FROM o JOIN k b ON b.s = o.s AND b.r = o.nr AND b.c = o.nc GROUP BY ALL)
SELECT {RC}, round(degrees(atan(sqrt((gy / 0.5) ** 2 + (gx / 0.5) ** 2))), 6) AS slope, round(step, 6) AS step, round(rough, 6) AS rough FROM gr JOIN st USING (s, r, c) JOIN ro USING (s, r, c)""")
def e01_terrain(spark, d):
    """Slope, step and roughness in one exchange."""
    return halo.terrain(_smooth(spark, d), 0.5, CHUNK)


_PT = "pt AS (SELECT o_orderkey AS point_id, o_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (o_custkey % 25)::INT AS pr, (o_orderkey % 40)::INT AS pc FROM orders WHERE o_orderstatus = 'P')"


def _points(spark, d) -> DataFrame:
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    o = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").crossJoin(F.broadcast(n))  # one row
    return o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % F.col("n_scenes")).alias("scene_id"), (F.col("o_custkey") % 25).cast("int").alias("row"), (F.col("o_orderkey") % 40).cast("int").alias("col"))


@query(f"""WITH {_H}, {_PT}, g AS (SELECT point_id, quantile_cont(z, 0.1) AS ground, max(z) FILTER (r = pr AND c = pc) AS z FROM pt JOIN k USING (s) WHERE NOT isnan(z) AND r >= pr - 4 AND r < pr + 4 AND c >= pc - 4 AND c < pc + 4 GROUP BY point_id)
SELECT point_id, round(ground, 6) AS ground, round(z - ground, 6) AS height, coalesce(z - ground >= 2, false) AS is_structure FROM g""")
def e21_ground_in_patch(spark, d):
    return halo.ground_in_patch(_points(spark, d), _holes(spark, d), 4)


@query(f"WITH {_H}, {_PT} SELECT point_id, round(max(z) - max(z) FILTER (r = pr AND c = pc), 6) AS peak FROM pt JOIN k USING (s) WHERE NOT isnan(z) AND abs(r - pr) <= 6 AND abs(c - pc) <= 6 GROUP BY point_id")
def e28_structure_peak(spark, d):
    return halo.structure_peak(_points(spark, d), _holes(spark, d))


# --- G: components and objects ------------------------------------------------------------------------------------


def _mask(spark, d) -> DataFrame:
    return fx.pixels(spark, d).where(F.col("cls").isin(2, 6)).select("scene_id", "row", "col")


def _recursive(where: str, near: str) -> str:
    return f"""RECURSIVE {EV}, m AS (SELECT s, r, c, s * 1000 + r * 40 + c AS id FROM ev WHERE {where}), e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON a.s = b.s AND a.id <> b.id AND {near}),
w(id, lab) AS (SELECT id, id FROM m UNION SELECT e.v, w.lab FROM w JOIN e ON e.u = w.id WHERE w.lab < e.v), lb AS (SELECT id, min(lab) AS lab FROM w GROUP BY id), cm AS (SELECT id // 1000 AS s, (id % 1000) // 40 AS r, id % 40 AS c, (lab % 1000) // 40 AS lr, lab % 40 AS lc, lab FROM lb)"""


_FOUR, _EIGHT = "abs(a.r - b.r) + abs(a.c - b.c) = 1", "abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1"
_IN = "cls IN (2, 6)"
_ALL4, _ALL8 = _recursive(_IN, _FOUR), _recursive("cls = 6", _EIGHT)


@query(f"WITH {_ALL4} SELECT s AS scene_id, r::INT AS \"row\", c::INT AS col, lr::INT AS label_row, lc::INT AS label_col FROM cm")
def g01_labels_4(spark, d):
    """The component of every pixel, over four neighbours."""
    return components.label_components(_mask(spark, d), 4, CHUNK)


@query(f"WITH {_ALL8} SELECT s AS scene_id, r::INT AS \"row\", c::INT AS col, lr::INT AS label_row, lc::INT AS label_col FROM cm")
def g01_labels_8(spark, d):
    return components.label_components(fx.pixels(spark, d).where("cls = 6"), 8, CHUNK)


@query(f"WITH {_ALL4} SELECT s AS scene_id, r::INT AS \"row\", c::INT AS col, lr::INT AS label_row, lc::INT AS label_col FROM cm QUALIFY count(*) OVER (PARTITION BY lab) >= 5")
def g02_filter_components(spark, d):
    return components.filter_components(components.label_components(_mask(spark, d), 4, CHUNK), 5)


@query(f"""WITH {_recursive("cls <> 6", _FOUR)}, ot AS (SELECT DISTINCT lab FROM cm WHERE r IN (0, 24) OR c IN (0, 39)) SELECT s AS scene_id, r AS "row", c AS col FROM ev WHERE cls = 6 UNION ALL SELECT s, r::INT, c::INT FROM cm WHERE lab NOT IN (SELECT lab FROM ot)""")
def g03_fill_holes(spark, d):
    px = fx.pixels(spark, d)
    return components.fill_holes(px.where("cls = 6"), px, fx.HEIGHT, fx.WIDTH, CHUNK)


@query(f"""WITH {_ALL4}, ob AS (SELECT cm.s, lr, lc, count(*) AS area, avg(cm.r) AS cy, avg(cm.c) AS cx, max(truth) AS mc, min(cm.r) AS row0, max(cm.r) + 1 AS row1, min(cm.c) AS col0, max(cm.c) + 1 AS col1 FROM cm JOIN ev ON ev.s = cm.s AND ev.r = cm.r AND ev.c = cm.c GROUP BY ALL)
SELECT s AS scene_id, lr::INT AS label_row, lc::INT AS label_col, area, round(cy, 6) AS cy, round(cx, 6) AS cx, mc AS max_conf, row0::INT AS row0, row1::INT AS row1, col0::INT AS col0, col1::INT AS col1, 'B' || lpad((row_number() OVER (PARTITION BY s ORDER BY lr, lc))::VARCHAR, 3, '0') AS object_id FROM ob""")
def g05_extract_objects(spark, d):
    values = fx.pixels(spark, d).select("scene_id", "row", "col", F.col("truth").alias("conf"))
    return components.extract_objects(components.label_components(_mask(spark, d), 4, CHUNK), values, 1)


_RING = f"""{_ALL4}, big AS (SELECT * FROM cm QUALIFY count(*) OVER (PARTITION BY lab) >= 5), rg AS (SELECT DISTINCT big.lab, k.r, k.c, k.s FROM big JOIN ev k ON k.s = big.s AND abs(k.r - big.r) <= 2 AND abs(k.c - big.c) <= 2 WHERE k.cls NOT IN (2, 6)),
bs AS (SELECT lab, quantile_cont(z, 0.2) AS base FROM rg JOIN ok USING (s, r, c) GROUP BY lab), ins AS (SELECT lab, lr, lc, big.s, coalesce(base, 0) AS base, z - coalesce(base, 0) AS rel FROM big JOIN ok ON ok.s = big.s AND ok.r = big.r AND ok.c = big.c LEFT JOIN bs USING (lab)),
md AS (SELECT s, lab, lr, lc, base, count(*) AS n, median(rel) AS m, quantile_cont(rel, 0.1) AS p10, quantile_cont(rel, 0.9) AS p90 FROM ins GROUP BY ALL), ft AS (SELECT lab, rel, abs(rel - m) AS far FROM ins JOIN md USING (lab)), ma AS (SELECT lab, median(far) * 1.4826 AS mad FROM ft GROUP BY lab),
tp AS (SELECT lab, median(rel) AS height FROM ft JOIN ma USING (lab) WHERE mad <= 1e-6 OR far <= 3 * mad GROUP BY lab)"""


@query(f"WITH {_RING} SELECT s AS scene_id, lr::INT AS label_row, lc::INT AS label_col, n, round(base, 6) AS base, round(height, 6) AS height, round(m, 6) AS median, round(mad, 6) AS mad, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM md JOIN ma USING (lab) JOIN tp USING (lab)")
def g08_object_height(spark, d):
    """Components of five pixels or more; the ring is what lies within two pixels outside the mask."""
    px = fx.pixels(spark, d)
    labels = components.filter_components(components.label_components(_mask(spark, d), 4, CHUNK), 5)
    steps = F.explode(F.array(*(F.lit(k) for k in range(-2, 3))))
    near = labels.select(*components.LABEL, "row", "col", steps.alias("dr")).select("*", steps.alias("dc"))
    near = near.select(*components.LABEL, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).distinct()
    ring = near.join(px.where("cls not in (2, 6)").select("scene_id", "row", "col"), components.KEYS)
    return components.object_height(labels, px.where(F.col("z") != fx.NODATA), ring)


@query(f"WITH {_ALL4}, {_PT.replace('FROM ev', 'FROM ev')}, st AS (SELECT point_id, lab FROM pt JOIN cm ON cm.s = pt.s AND cm.r = pr AND cm.c = pc) SELECT point_id, count(*) AS n_reached FROM st JOIN cm USING (lab) GROUP BY point_id")
def g19_reachable(spark, d):
    found = components.reachable(components.label_components(_mask(spark, d), 4, CHUNK), _points(spark, d))
    return found.groupBy("point_id").agg(F.count("*").alias("n_reached"))


@query(f"WITH {_ALL4}, n AS (SELECT s, lr, lc, count(*) AS area FROM cm GROUP BY ALL) SELECT s AS scene_id, lr::INT AS label_row, lc::INT AS label_col, area, row_number() OVER (PARTITION BY s ORDER BY area DESC, lr, lc) AS place FROM n QUALIFY place <= 10")
def i02_largest_components(spark, d):
    return components.largest_components(components.label_components(_mask(spark, d), 4, CHUNK), 10)
