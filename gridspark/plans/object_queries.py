"""Registered queries of outlines and of what lies under a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators import components, levels, outlines, picking, planar, rectangles
from gridspark.plans.kernel_queries import _ALL4, _mask
from gridspark.plans.lineage import cut
from gridspark.plans.registry import query
from gridspark.sources import fixtures as fx

CHUNK = 16
# Corners of the fixture's features around their centre, in eighths of their size; the last repeats the first.
_CORNERS = [(-8, -8), (8, -6), (2, 0), (7, 8), (-6, 5), (-8, -8)]


@query()
def g06_polygonize(spark, d):
    """The corners of all rings of every component; compared with a walk around each in tests."""
    return outlines.polygonize(components.label_components(_mask(spark, d), 4, CHUNK), CHUNK)


def _is(a: int, b: int) -> str:
    return f"EXISTS (SELECT 1 FROM cm q WHERE q.lab = cm.lab AND q.r = cm.r + {a} AND q.c = cm.c + {b})"


@query(f"""WITH {_ALL4}, nb AS (SELECT lab, s, lr, lc, {', '.join(f"{_is(a, b)} AS n{k}" for k, (a, b) in enumerate([(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]))} FROM cm)
SELECT s AS scene_id, lr::INT AS label_row, lc::INT AS label_col, count(*)::DOUBLE AS area, sum({' + '.join(f"(CASE WHEN (NOT n{(k - 1) % 8} AND NOT n{(k + 1) % 8}) OR (n{(k - 1) % 8} AND n{(k + 1) % 8} AND NOT n{k}) THEN 1 ELSE 0 END)" for k in (0, 2, 4, 6))})::BIGINT AS corners FROM nb GROUP BY ALL""")
def g06_outline_totals(spark, d):
    """Area within the rings of every component, holes taken off, and their corners: the pixels and the corners counted at them."""
    rings = outlines.polygonize(components.label_components(_mask(spark, d), 4, CHUNK), CHUNK)
    ring = Window.partitionBy(*components.LABEL, "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    cross = rings.select(*components.LABEL, (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("k"))
    return cross.groupBy(*components.LABEL).agg((F.sum("k") / 2.0).alias("area"), F.count("*").alias("corners"))


def _rings(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    corner = F.posexplode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _CORNERS))).alias("seq", "p")
    size = k % 9 + 4
    return fx.table(spark, d, "supplier").select((k % 3).alias("scene_id"), k.alias("feature"), (k * 37 % 300).alias("cx"), (k * 53 % 200).alias("cy"), size.alias("size"), corner).select(
        "scene_id", "feature", "seq", (F.col("cx") + F.col("p.a") * F.col("size") / 8.0).alias("x"), (F.col("cy") + F.col("p.b") * F.col("size") / 8.0).alias("y"))


@query(f"""WITH v AS (SELECT s_suppkey % 3 AS s, s_suppkey AS f, i, s_suppkey * 37 % 300 + a * (s_suppkey % 9 + 4) / 8.0::DOUBLE AS x, s_suppkey * 53 % 200 + b * (s_suppkey % 9 + 4) / 8.0::DOUBLE AS y FROM supplier, (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(_CORNERS))}) t(i, a, b)),
e AS (SELECT a.s, a.f, a.x, a.y, b.x AS u, b.y AS w FROM v a JOIN v b ON a.f = b.f AND b.i = (a.i + 1) % {len(_CORNERS)}), ct AS (SELECT s, f, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY ALL),
p AS (SELECT o_orderkey AS id, o_orderkey % 3 AS s, (o_custkey * 7 % 3100) / 10.0::DOUBLE AS px, (o_orderkey * 11 % 2100) / 10.0::DOUBLE AS py FROM orders),
ins AS (SELECT id, min(f) AS f FROM (SELECT id, f FROM p JOIN e ON e.s = p.s AND (y > py) <> (w > py) AND px < (u - x) * (py - y) / (w - y) + x GROUP BY id, f HAVING count(*) % 2 = 1) GROUP BY id),
nr AS (SELECT id, arg_min(f, (d, f)) AS f FROM (SELECT id, f, sqrt((px - cx) ** 2 + (py - cy) ** 2) AS d FROM p JOIN ct ON ct.s = p.s) WHERE d < 15 GROUP BY id)
SELECT p.id AS point_id, coalesce(ins.f, nr.f) AS feature, ins.f IS NOT NULL AS inside FROM p LEFT JOIN ins ON ins.id = p.id LEFT JOIN nr ON nr.id = p.id""")
def c23_object_at_point(spark, d):
    """The feature under each order's point, or the nearest."""
    points = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 3).alias("scene_id"), (F.col("o_custkey") * 7 % 3100 / 10.0).alias("x"), (F.col("o_orderkey") * 11 % 2100 / 10.0).alias("y"))
    return picking.object_at_point(points, _rings(spark, d))


def _blocks(spark, d) -> tuple[DataFrame, DataFrame]:
    """Labels of pixels of three classes, whose components are large, and all pixels with heights from ``truth``."""
    px = fx.pixels(spark, d)
    return components.label_components(px.where(F.col("cls").isin(2, 6, 9)).select("scene_id", "row", "col"), 4, CHUNK), px


@query()
def g09_object_levels(spark, d):
    """Upper levels of every component; compared with plain Python in tests."""
    labels, px = _blocks(spark, d)
    labels = cut(labels)
    objects = labels.select(*components.LABEL, F.lit(0.0).alias("base"), F.lit(0.5).alias("height")).distinct()
    return levels.object_levels(labels, px.withColumn("z", F.col("truth") / 10), objects, least=5, chunk=CHUNK)[0]


@query()
def g17_planar_refine(spark, d):
    """The verdict on the plane of every component; heights are a slope with a part of ``truth`` on it. Compared with plain Python in tests."""
    labels, px = _blocks(spark, d)
    return planar.planar_refine(px.withColumn("z", F.col("col") * 0.2 - F.col("row") * 0.1 + F.col("truth") / 30), labels, least=12)[1]


@query()
def g11_rect_decompose(spark, d):
    """The rectangles of every component that is made of several; compared with plain Python in tests."""
    return rectangles.rect_decompose(_blocks(spark, d)[0])
