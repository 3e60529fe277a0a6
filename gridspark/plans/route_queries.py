"""Registered queries of routes and nearest seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import distance, routes
from gridspark.plans.registry import EV, query
from gridspark.sources import fixtures as fx

CHUNK = 16


def _routes(spark, d) -> DataFrame:
    """A route for each supplier, through one of the scenes."""
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n"))
    k = F.col("s_suppkey")
    place = [("start_row", k * 7 % 25), ("start_col", k * 11 % 40), ("goal_row", (k * 13 + 5) % 25), ("goal_col", (k * 17 + 20) % 40)]
    return fx.table(spark, d, "supplier").crossJoin(F.broadcast(n)).select(k.alias("route_id"), (k % F.col("n")).alias("scene_id"), *(v.cast("int").alias(c) for c, v in place))  # one row


def _costs(spark, d) -> DataFrame:
    return fx.pixels(spark, d).select("scene_id", "row", "col", F.when(F.col("cls") != 6, 0.65 + F.col("truth") % 5).alias("cost"))


@query(f"""WITH RECURSIVE {EV}, k AS (SELECT s, r, c, CASE WHEN cls <> 6 THEN 0.65::DOUBLE + truth % 5 END AS cost FROM ev), o AS (SELECT * FROM k WHERE cost IS NOT NULL),
q AS (SELECT s_suppkey AS id, s_suppkey % (SELECT max(s) + 1 FROM ev) AS s, s_suppkey * 7 % 25 AS sr, s_suppkey * 11 % 40 AS sc, (s_suppkey * 13 + 5) % 25 AS gr, (s_suppkey * 17 + 20) % 40 AS gc FROM supplier),
fit AS (SELECT q.* FROM q JOIN o a ON a.s = q.s AND a.r = sr AND a.c = sc JOIN o b ON b.s = q.s AND b.r = gr AND b.c = gc),
w(id, s, r, c, d) USING KEY (id, r, c) AS (SELECT id, s, sr::BIGINT, sc::BIGINT, 0::DOUBLE FROM fit UNION
  SELECT n.id, n.s, n.r, n.c, n.d FROM (SELECT w.id, w.s, o.r::BIGINT AS r, o.c::BIGINT AS c, min(w.d + CASE WHEN o.r <> w.r AND o.c <> w.c THEN sqrt(2) ELSE 1 END * o.cost) AS d FROM w JOIN o ON o.s = w.s AND abs(o.r - w.r) <= 1 AND abs(o.c - w.c) <= 1 GROUP BY ALL) n
  LEFT JOIN recurring.w h ON h.id = n.id AND h.r = n.r AND h.c = n.c WHERE h.d IS NULL OR n.d < h.d)
SELECT q.id AS route_id, round(w.d, 6) AS cost FROM q LEFT JOIN w ON w.id = q.id AND w.r = gr AND w.c = gc""")
def g20_least_cost(spark, d):
    """Cost of the cheapest path of every route; null where there is none."""
    return routes.least_cost(_costs(spark, d), _routes(spark, d), CHUNK, paths=False)[0]


@query()
def g20_least_cost_paths(spark, d):
    """The cells of the cheapest path of every route."""
    return routes.least_cost(_costs(spark, d), _routes(spark, d), CHUNK)[1]


@query(f"""WITH {EV}, sd AS (SELECT s, r, c FROM ev WHERE cls = 9 AND truth % 4 = 0)
SELECT h.s AS scene_id, h.r AS "row", h.c AS col, (arg_min(sd.r, ((h.r - sd.r) ** 2 + (h.c - sd.c) ** 2) * 1000 + sd.r * 40 + sd.c))::INT AS seed_row, (arg_min(sd.c, ((h.r - sd.r) ** 2 + (h.c - sd.c) ** 2) * 1000 + sd.r * 40 + sd.c))::INT AS seed_col, min((h.r - sd.r) ** 2 + (h.c - sd.c) ** 2)::BIGINT AS d2
FROM ev h JOIN sd USING (s) WHERE h.cls IN (2, 6) GROUP BY ALL""")
def c22_nearest_seed(spark, d):
    """The nearest seed of every hot pixel."""
    px = fx.pixels(spark, d)
    return distance.nearest_seed(px.select("scene_id", "row", "col", F.col("cls").isin(2, 6).alias("hot"), ((F.col("cls") == 9) & (F.col("truth") % 4 == 0)).alias("seed")))
