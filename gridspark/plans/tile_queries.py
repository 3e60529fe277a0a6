"""Registered queries of pyramids of tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import pyramid
from gridspark.plans.kernel_queries import _H, _holes
from gridspark.plans.registry import query
from gridspark.sources import fixtures as fx

DEEPEST, SIZE = 3, 4


def _axis(name: str, extent: int) -> str:
    """SQL: the cells of every level of an axis, from a to b."""
    return f"""{name} AS (SELECT z, k, i, lo + i * (hi - lo) / {SIZE}::DOUBLE AS a, lo + (i + 1) * (hi - lo) / {SIZE}::DOUBLE AS b FROM (
  SELECT z, k, round_even(k * {extent} / (2.0::DOUBLE ** z), 0) AS lo, round_even((k + 1) * {extent} / (2.0::DOUBLE ** z), 0) AS hi
  FROM (SELECT unnest(range({DEEPEST + 1})) AS z), (SELECT unnest(range({1 << DEEPEST})) AS k) WHERE k < 2 ** z), (SELECT unnest(range({SIZE})) AS i))"""


def _link(name: str, axis: str) -> str:
    """SQL: the share of each cell of a level in the cells of the level above."""
    return f"{name} AS (SELECT p.z, c.k AS k0, c.i AS i0, p.k, p.i, (least(p.b, c.b) - greatest(p.a, c.a)) / (c.b - c.a) AS w FROM {axis} p JOIN {axis} c ON c.z = p.z + 1 AND c.a < p.b - 1e-9 AND c.b > p.a + 1e-9)"


def _level(z: int) -> str:
    return f"""l{z} AS (SELECT s, y.k AS y, x.k AS x, y.i AS i, x.i AS j, sum(wz * y.w * x.w) AS wz, sum(l.w * y.w * x.w) AS w
  FROM l{z + 1} l JOIN ly y ON y.z = {z} AND y.k0 = l.y AND y.i0 = l.i JOIN lx x ON x.z = {z} AND x.k0 = l.x AND x.i0 = l.j GROUP BY ALL)"""


@query(f"""WITH {_H}, {_axis('ay', fx.HEIGHT)}, {_axis('ax', fx.WIDTH)}, {_link('ly', 'ay')}, {_link('lx', 'ax')},
l{DEEPEST} AS (SELECT s, y.k AS y, x.k AS x, y.i AS i, x.i AS j, sum(CASE WHEN isnan(p.z) THEN 0 ELSE p.z END * (least(y.b, r + 1) - greatest(y.a, r)) * (least(x.b, c + 1) - greatest(x.a, c))) AS wz,
  sum(CASE WHEN isnan(p.z) THEN 0 ELSE 1 END * (least(y.b, r + 1) - greatest(y.a, r)) * (least(x.b, c + 1) - greatest(x.a, c))) AS w
  FROM k p JOIN ay y ON y.z = {DEEPEST} AND y.a < r + 1 AND y.b > r JOIN ax x ON x.z = {DEEPEST} AND x.a < c + 1 AND x.b > c GROUP BY ALL),
{", ".join(_level(z) for z in range(DEEPEST - 1, -1, -1))}, st AS (SELECT s, min(z) AS lo, max(z) AS hi FROM k WHERE NOT isnan(z) GROUP BY s),
a AS ({" UNION ALL ".join(f"SELECT s, {z} AS z, y, x, i, j, CASE WHEN w > 1e-9 THEN wz / w END AS h FROM l{z}" for z in range(DEEPEST + 1))})
SELECT s AS scene_id, z::INT AS z, y::INT AS y, x::INT AS x, i::INT AS i, j::INT AS j, round(h, 6) AS height, CASE WHEN h IS NULL OR hi - lo < 1e-6 THEN 32768 ELSE round_even(least(greatest((h - lo) / (hi - lo), 0), 1) * 65535, 0) END::INT AS code FROM a JOIN st USING (s)""")
def f11_pyramid(spark, d):
    """Levels 0 to 3 of every scene in tiles of 4 x 4 cells."""
    return pyramid.pyramid(_holes(spark, d).select("scene_id", "row", "col", F.col("z")), fx.scenes(spark, d), DEEPEST, SIZE)
