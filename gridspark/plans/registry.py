"""Registered queries of the raster operators and their SQL for DuckDB.

Floats are rounded on both sides, since sums run in another order. Every query reads the given tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite
from gridspark.operators import focal, joins, metrics, pixels, splits, tiling
from gridspark.plans.graph import connected_components
from gridspark.sources import fixtures as fx
from gridspark.streaming import jobs

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
NODATA = fx.NODATA

_CLS = "CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 9 ELSE 65 END"
_Z = "CASE WHEN event_id % 37 = 0 THEN 'nan'::DOUBLE WHEN event_id % 41 = 0 THEN -9999.0 ELSE value END"
EV = f"""ev AS (SELECT event_id // 1000 AS s, ((event_id % 1000) // 40)::INT AS r, (event_id % 40)::INT AS c, {_Z} AS z,
  regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS truth, {_CLS} AS cls FROM events),
ok AS (SELECT * FROM ev WHERE NOT isnan(z) AND z <> -9999)"""
LI = "li AS (SELECT l_suppkey AS tile, l_returnflag AS split, l_linestatus AS city, l_linenumber::INT AS cls, l_extendedprice / 1000 AS pred, l_quantity AS truth FROM lineitem)"
ERRORS = """count(*) AS n, round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) ** 2)), 6) AS rmse, round(avg(pred - truth), 6) AS bias,
  round(coalesce(CASE WHEN stddev_pop(pred) > 1e-9 AND stddev_pop(truth) > 1e-9 THEN corr(pred, truth) END, 'nan'::DOUBLE), 6) AS r, round(avg((pred < 0)::INT), 6) AS neg_frac"""
STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
JOBS = f"j AS (SELECT user_id AS job_id, user_id % 20 AS scene_id, ts, {STATUS} AS status, event_id FROM events)"
BOXES = """b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 3600) / 10.0::DOUBLE - 180 AS west, (s_suppkey * 53 % 1600) / 10.0::DOUBLE - 80 AS south FROM supplier),
boxes AS (SELECT id, west, south, west + 0.3 + (id % 7) / 4.0::DOUBLE AS east, south + 0.2 + (id % 5) / 4.0::DOUBLE AS north FROM b)"""


def query(oracle: str | None = None, digits: int = 6):
    """Register a query under its function's name; float columns are rounded."""

    def register(f: Callable) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _pairs(spark, d) -> DataFrame:
    px = fx.pixels(spark, d).where(finite(F.col("z")) & (F.col("z") != NODATA))
    return px.select("scene_id", "row", "col", "cls", F.col("z").alias("pred"), "truth")


def _ok(spark, d) -> DataFrame:
    return fx.pixels(spark, d).where(finite(F.col("z")) & (F.col("z") != NODATA))


# --- A: scans, listings -------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(z, 6) AS z, round(truth, 6) AS truth, cls FROM ev WHERE s < 2")
def a01_scan_pixels(spark, d):
    """Scenes 0 and 1; the range of scenes is the operator's filter."""
    return fx.pixels(spark, d).where("scene_id < 2")


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(z, 6) AS z, round(truth, 6) AS truth, cls FROM ev")
def a01_scan_all_pixels(spark, d):
    """Every pixel of every scene."""
    return fx.pixels(spark, d)


@query(f"""WITH {EV} SELECT s AS scene_id, r // 8 AS cr, c // 8 AS cc, count(*) AS n, round(sum(CASE WHEN isnan(z) THEN 0 ELSE z END), 6) AS total FROM ev GROUP BY ALL""")
def a03_chunks(spark, d):
    px = fx.pixels(spark, d).withColumns({"cr": F.floor(F.col("row") / 8), "cc": F.floor(F.col("col") / 8)})
    chunks = px.groupBy("scene_id", "cr", "cc").agg(F.array_sort(F.collect_list(F.struct("row", "col", "z"))).alias("data"))
    back = chunks.select("scene_id", "cr", "cc", F.explode("data").alias("p")).select("scene_id", "cr", "cc", "p.*")
    return back.groupBy("scene_id", "cr", "cc").agg(F.count("*").alias("n"), F.sum(F.when(F.isnan("z"), 0.0).otherwise(F.col("z"))).alias("total"))


@query(f"WITH {EV} SELECT s AS scene_id, r - 5 AS \"row\", c - 8 AS col, round(z, 6) AS z FROM ev WHERE r BETWEEN 5 AND 14 AND c BETWEEN 8 AND 27")
def a04_crop(spark, d):
    return pixels.crop(fx.pixels(spark, d), 5, 8, 10, 20).select("scene_id", "row", "col", "z")


_STEMS = "st AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'broken' || o_orderkey ELSE upper(substr(o_orderpriority, 3, 3)) || '_' || lpad((o_orderkey % 60)::VARCHAR, 3, '0') || '_' || lpad((o_custkey % 30)::VARCHAR, 3, '0') END AS stem FROM orders)"


def _stems(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    city = F.upper(F.substring("o_orderpriority", 3, 3))
    stem = F.concat(city, F.lit("_"), F.lpad((k % 60).cast("string"), 3, "0"), F.lit("_"), F.lpad((F.col("o_custkey") % 30).cast("string"), 3, "0"))
    return fx.table(spark, d, "orders").select("o_orderkey", F.when(k % 11 == 0, F.concat(F.lit("broken"), k.cast("string"))).otherwise(stem).alias("stem"))


@query(f"""WITH {_STEMS}, m AS (SELECT o_orderkey, stem, regexp_matches(stem, '^[A-Za-z]+_[0-9]+_[0-9]+$') AS ok FROM st)
SELECT o_orderkey, stem, ok, CASE WHEN ok THEN split_part(stem, '_', 1) END AS city, CASE WHEN ok THEN split_part(stem, '_', 2)::INT END AS "row", CASE WHEN ok THEN split_part(stem, '_', 3)::INT END AS col FROM m""")
def a06_parse_stem(spark, d):
    stems = _stems(spark, d)
    return stems.join(splits.parse_stem(stems.select("stem").distinct()), "stem").select("o_orderkey", "stem", "ok", "city", "row", "col")


@query("SELECT l_returnflag AS split, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 20")
def a07_list_split(spark, d):
    li = fx.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "split")
    return splits.first_of_split(li, 20, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").select("split", "l_orderkey", "l_linenumber", "rank")


@query(f"WITH {EV}, f AS (SELECT s, greatest(1, ceil(40 / 16.0))::INT AS k FROM (SELECT DISTINCT s FROM ev)) SELECT s AS scene_id, r AS \"row\", c AS col, round(z, 3) AS z FROM ev JOIN f USING (s) WHERE r % k = 0 AND c % k = 0", 3)
def a17_payload_grid(spark, d):
    step = max(1, -(-fx.WIDTH // 16))
    return pixels.stride_sample(fx.pixels(spark, d), step).select("scene_id", "row", "col", "z")


# --- B: maps ------------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT s AS scene_id, sum(isnan(z)::INT) AS n_nan, sum((z = -9999)::INT) AS n_nodata, sum((isnan(z) OR z = -9999)::INT) AS n_invalid FROM ev GROUP BY ALL")
def b01_invalid_mask(spark, d):
    m = pixels.invalid_mask(fx.pixels(spark, d), NODATA)
    return m.groupBy("scene_id").agg(F.sum(F.col("is_nan").cast("int")).alias("n_nan"), F.sum(F.col("is_nodata").cast("int")).alias("n_nodata"), F.sum(F.col("invalid").cast("int")).alias("n_invalid"))


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN isnan(z) THEN -9999 ELSE z END, 6) AS z FROM ev")
def b02_clean_dem(spark, d):
    return pixels.clean_dem(fx.pixels(spark, d), NODATA).select("scene_id", "row", "col", "z")


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN isnan(z) THEN 0 ELSE greatest(z, 0) END, 6) AS agl, NOT isnan(z) AS target_ok FROM ev")
def b03_clean_agl(spark, d):
    return pixels.clean_agl(fx.pixels(spark, d)).select("scene_id", "row", "col", "agl", "target_ok")


_RANGE = f"{EV}, st AS (SELECT s, min(z) AS lo, max(z) AS hi, avg(z) AS m, stddev_pop(z) AS sd FROM ok GROUP BY s)"


@query(f"WITH {_RANGE} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN NOT isnan(z) AND z <> -9999 THEN CASE WHEN hi - lo < 1e-6 THEN 0.5 ELSE (z - lo) / (hi - lo) END END, 6) AS dn FROM ev JOIN st USING (s)")
def b04_minmax_tile(spark, d):
    return pixels.minmax_tile(fx.pixels(spark, d), NODATA).select("scene_id", "row", "col", "dn")


@query(f"WITH {_RANGE} SELECT s AS scene_id, round(ln(greatest(lo, 0) + 1e-3), 6) AS ln_lo, round(ln(greatest(hi, 0) + 1e-3), 6) AS ln_hi, round(ln(hi - lo + 1e-3), 6) AS ln_range, round(ln(m + 1e-3), 6) AS ln_mean FROM st")
def b05_tile_stats4(spark, d):
    return pixels.tile_stats4(fx.pixels(spark, d), NODATA)


@query(f"WITH {_RANGE} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN NOT isnan(z) AND z <> -9999 THEN (z - m) / sd ELSE -1 END, 6) AS norm FROM ev JOIN st USING (s)")
def b06_normalize_dem(spark, d):
    return pixels.normalize_dem(fx.pixels(spark, d), "zscore", NODATA)[0].select("scene_id", "row", "col", "norm")


@query(f"WITH {_RANGE} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN NOT isnan(z) AND z <> -9999 THEN z END, 4) AS restored FROM ev JOIN st USING (s)", 4)
def b06_denormalize(spark, d):
    norm, params = pixels.normalize_dem(fx.pixels(spark, d), "minmax", NODATA)
    return pixels.denormalize(norm, params).select("scene_id", "row", "col", "restored")


_STRETCH = f"{EV}, p AS (SELECT s, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM ok GROUP BY s), u AS (SELECT s, r, c, greatest(0, least(1, (z - lo) / (hi - lo))) AS unit FROM ok JOIN p USING (s))"


@query(f"WITH {_STRETCH} SELECT s AS scene_id, r AS \"row\", c AS col, round(unit, 6) AS unit FROM u")
def b10_stretch_to_01(spark, d):
    return pixels.stretch_to_01(fx.pixels(spark, d), nodata=NODATA).where("unit is not null").select("scene_id", "row", "col", "unit")


@query(f"WITH {_STRETCH} SELECT s AS scene_id, round_even(unit * 255, 0)::INT AS q, count(*) AS n FROM u GROUP BY ALL")
def b10_quantize_u8(spark, d):
    u = pixels.stretch_to_01(fx.pixels(spark, d), nodata=NODATA).where("unit is not null")
    return u.groupBy("scene_id", pixels.quantize(F.col("unit")).alias("q")).agg(F.count("*").alias("n"))


@query(f"WITH {_RANGE} SELECT s AS scene_id, r AS \"row\", c AS col, round_even((z - lo) / (hi - lo) * 65535, 0)::INT AS u16 FROM ok JOIN st USING (s)")
def b11_encode_u16(spark, d):
    return pixels.encode_u16(fx.pixels(spark, d), NODATA).where("u16 is not null").select("scene_id", "row", "col", "u16")


@query("SELECT event_id, round((0.299 * (event_id % 256) + 0.587 * (event_id * 7 % 256) + 0.114 * (event_id * 13 % 256)) / 255, 6) AS grey FROM events")
def b12_luma(spark, d):
    e = F.col("event_id")
    return fx.table(spark, d, "events").select("event_id", pixels.luma(e % 256, e * 7 % 256, e * 13 % 256).alias("grey"))


@query(f"WITH {EV} SELECT s AS scene_id, CASE cls WHEN 2 THEN 0 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 9 THEN 3 ELSE 255 END AS project_cls, count(*) AS n FROM ev GROUP BY ALL")
def b16_map_classes(spark, d):
    legend = spark.createDataFrame([(2, 0), (5, 1), (6, 2), (9, 3)], "cls int, project_cls int")
    return pixels.map_classes(fx.pixels(spark, d), legend)[0].groupBy("scene_id", "project_cls").agg(F.count("*").alias("n"))


@query("SELECT vec_id, (list_position(p, list_max(p)) - 1)::INT AS label, round(list_max(p) / list_sum(p), 6) AS conf FROM (SELECT vec_id, list_transform(embedding[1:6], lambda x: exp(x::DOUBLE)) AS p FROM embeddings)")
def b17_probs_to_labels(spark, d):
    label, conf = pixels.probs_to_labels(pixels.softmax(F.slice("embedding", 1, 6)))
    return fx.table(spark, d, "embeddings").select("vec_id", label.alias("label"), conf.alias("conf"))


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(500000 + 20 * s + (c + 0.5) * 0.5, 6) AS x, round(5600000 - (r + 0.5) * 0.5, 6) AS y FROM ev")
def b19_pixel_to_world(spark, d):
    px = fx.pixels(spark, d).join(fx.scenes(spark, d).select("scene_id", "x0", "y0", "res"), "scene_id")
    x, y = pixels.pixel_to_world(F.col("row"), F.col("col"), F.col("x0"), F.col("y0"), F.col("res"), centre=True)
    return px.select("scene_id", "row", "col", x.alias("x"), y.alias("y"))


@query(f"WITH {EV} SELECT s AS scene_id, 39 - c AS \"row\", r AS col, round(z, 6) AS z FROM ev")
def b23_rot90(spark, d):
    return pixels.flip_rotate(fx.pixels(spark, d), "rot90", fx.HEIGHT, fx.WIDTH).select("scene_id", "row", "col", "z")


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY r, c) - 1 AS k FROM ev WHERE NOT isnan(z)) SELECT s AS scene_id, r AS \"row\", c AS col, round(z, 6) AS z FROM n WHERE k % 7 = 0")
def b24_stride_valid(spark, d):
    return pixels.running_index(fx.pixels(spark, d), 7).select("scene_id", "row", "col", "z")


@query("SELECT s_suppkey, substr(sha256(printf('%.6f,%.6f', (s_suppkey * 37 % 3600) / 10.0 - 180, (s_suppkey * 53 % 1600) / 10.0 - 80)), 1, 8) AS key FROM supplier")
def b29_footprint_key(spark, d):
    return fx.footprints(spark, d).select(F.col("id").alias("s_suppkey"), F.substring(F.sha2(F.format_string("%.6f,%.6f", "west", "south"), 256), 1, 8).alias("key"))


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(CASE WHEN truth >= 80 THEN 1e9 ELSE (1 + 4 * (truth / 100) ** 2 + 3 * (z / 500) ** 2) * CASE WHEN truth >= 50 THEN 1.5 ELSE 1 END END, 6) AS cost FROM ok")
def b33_soft_cost(spark, d):
    cls = F.when(F.col("truth") >= 80, 2).when(F.col("truth") >= 50, 1).otherwise(0)
    return _ok(spark, d).select("scene_id", "row", "col", pixels.soft_cost(F.col("truth"), F.col("z"), 100.0, 500.0, cls).alias("cost"))


@query(f"WITH {BOXES} SELECT id, round((east - west) * (north - south), 6) AS area FROM boxes")
def b40_ring_area(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north"))
    return fx.footprints(spark, d).select("id", pixels.ring_area(ring).alias("area"))


# --- C: joins -----------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT s AS scene_id, count(*) AS n, round(avg(a.z - 2 * b.truth), 6) AS mean_diff FROM ok a JOIN ev b USING (s, r, c) GROUP BY ALL")
def c01_align(spark, d):
    px = fx.pixels(spark, d)
    pairs, _ = joins.align(_ok(spark, d), px.withColumn("z", F.col("truth") * 2))
    return pairs.groupBy("scene_id").agg(F.count("*").alias("n"), F.avg(F.col("pred") - F.col("truth")).alias("mean_diff"))


@query(f"WITH {EV} SELECT s AS scene_id, 'GRID_MISMATCH' AS status_code, count(*) AS lost FROM ev WHERE isnan(z) OR z = -9999 GROUP BY s")
def c01_grid_mismatch(spark, d):
    return joins.align(_ok(spark, d), fx.pixels(spark, d))[1]


_TAPS = f"""{EV}, q AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, l_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (l_partkey % 100) / 100.0::DOUBLE * 26 - 1 AS v, (l_suppkey % 10) / 10.0::DOUBLE * 41 - 1 AS u
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
t AS (SELECT point_id, s, floor(v) + di AS r, floor(u) + dj AS c, CASE WHEN di = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE WHEN dj = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END AS w
  FROM q, (VALUES (0), (1)) a(di), (VALUES (0), (1)) b(dj)),
h AS (SELECT t.*, ok.z FROM t LEFT JOIN ok ON ok.s = t.s AND ok.r = t.r AND ok.c = t.c)
SELECT point_id, round(CASE WHEN sum(CASE WHEN z IS NULL THEN 0 ELSE w END) > 0 THEN sum(CASE WHEN z IS NULL THEN 0 ELSE w * z END) / sum(CASE WHEN z IS NULL THEN 0 ELSE w END) ELSE 'nan'::DOUBLE END, 5) AS z FROM h GROUP BY point_id"""


@query(f"WITH {_TAPS}", 5)
def c02_resample_bilinear(spark, d):
    px = _ok(spark, d)
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    li = joins.pick_first(fx.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey").crossJoin(F.broadcast(n))  # one row
    points = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), (F.col("l_orderkey") % F.col("n_scenes")).alias("scene_id"), ((F.col("l_partkey") % 100) / 100.0 * 26 - 1).alias("v"), ((F.col("l_suppkey") % 10) / 10.0 * 41 - 1).alias("u"))
    return joins.resample_bilinear(px, points)


@query(f"WITH {BOXES} SELECT id, lat, lon FROM (SELECT id, unnest(range(floor(south)::BIGINT, greatest(ceil(north)::BIGINT, floor(south)::BIGINT + 1))) AS lat, west, east FROM boxes), LATERAL (SELECT unnest(range(floor(west)::BIGINT, greatest(ceil(east)::BIGINT, floor(west)::BIGINT + 1))) AS lon)")
def c04_cover_cells(spark, d):
    return joins.cover_cells(fx.footprints(spark, d)).select("id", "lat", "lon")


_MEET = "x.west <= y.east AND y.west <= x.east AND x.south <= y.north AND y.south <= x.north"


@query(f"WITH {BOXES} SELECT x.id AS a, y.id AS b FROM boxes x JOIN boxes y ON x.id < y.id AND {_MEET}")
def c05_adjacency(spark, d):
    return joins.adjacency(fx.footprints(spark, d))


@query(f"WITH {BOXES} SELECT id FROM boxes x WHERE NOT EXISTS (SELECT 1 FROM boxes y WHERE x.id <> y.id AND {_MEET})")
def c05_scattered(spark, d):
    boxes = fx.footprints(spark, d)
    return joins.scattered(boxes, joins.adjacency(boxes))


@query(f"WITH {EV} SELECT s % 5 = 4 AS other, s AS scene_id, 'CRS_MISMATCH' AS status_code FROM (SELECT DISTINCT s FROM ev) WHERE s % 5 = 4")
def c06_mosaic_check(spark, d):
    return tiling.mosaic_problems(fx.scenes(spark, d)).select((F.col("scene_id") % 5 == 4).alias("other"), "scene_id", "status_code")


@query(f"WITH {EV} SELECT s * 100 + cls AS object_id, count(*) AS n, round(avg(z), 6) AS mean, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM ok GROUP BY ALL")
def c07_zonal(spark, d):
    px = fx.pixels(spark, d)
    return joins.zonal(px.select("scene_id", "row", "col", (F.col("scene_id") * 100 + F.col("cls")).alias("object_id")), px.select("scene_id", "row", "col", "z"))


@query(f"""WITH {EV}, q AS (SELECT o_orderkey AS point_id, o_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (o_custkey % 28 - 1)::INT AS r, (o_orderkey % 43 - 1)::INT AS c FROM orders)
SELECT point_id, CASE WHEN NOT (q.r BETWEEN 0 AND 24 AND q.c BETWEEN 0 AND 39) THEN 'out_of_grid' WHEN z IS NULL THEN 'no_data' ELSE 'ok' END AS status, round(CASE WHEN q.r BETWEEN 0 AND 24 AND q.c BETWEEN 0 AND 39 THEN z END, 6) AS z
FROM q LEFT JOIN ok ON ok.s = q.s AND ok.r = q.r AND ok.c = q.c""")
def c15_sample_points(spark, d):
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    o = fx.table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    points = o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % F.col("n_scenes")).alias("scene_id"), (F.col("o_custkey") % 28 - 1).cast("int").alias("row"), (F.col("o_orderkey") % 43 - 1).cast("int").alias("col"))
    return joins.sample_points(points, fx.pixels(spark, d), fx.HEIGHT, fx.WIDTH)


# --- D: metrics ---------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT s AS scene_id, sum(isnan(z)::INT) AS n_nan, sum((abs(z) = 'inf'::DOUBLE)::INT) AS n_inf, sum((z = -9999)::INT) AS n_nodata, sum((NOT isnan(z) AND z <> -9999)::INT) AS n_valid, round(min(z) FILTER (NOT isnan(z) AND z <> -9999), 6) AS z_min, round(max(z) FILTER (NOT isnan(z) AND z <> -9999), 6) AS z_max, round(avg(z) FILTER (NOT isnan(z) AND z <> -9999), 6) AS z_mean FROM ev GROUP BY s")
def d01_raster_inspect(spark, d):
    return metrics.inspect(fx.pixels(spark, d), NODATA)


_PAIRS = f"{EV}, p AS (SELECT s AS scene_id, cls, z AS pred, truth FROM ok)"


@query(f"WITH {_PAIRS} SELECT scene_id, round(median(abs(pred - truth)), 6) AS medae, {ERRORS} FROM p GROUP BY scene_id")
def d04_height_metrics(spark, d):
    return metrics.height_metrics(_pairs(spark, d), "scene_id")


@query(f"WITH {LI} SELECT split, {ERRORS} FROM li GROUP BY split")
def d05_pooled_metrics(spark, d):
    return metrics.pooled_metrics(fx.metric_pairs(spark, d), "split")


@query(f"WITH {LI}, t AS (SELECT tile, city, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) ** 2)) AS rmse FROM li GROUP BY ALL) SELECT city, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, count(*) AS n_tiles FROM t GROUP BY city")
def d06_mean_std_over_tiles(spark, d):
    return metrics.mean_std_over_tiles(metrics.pooled_metrics(fx.metric_pairs(spark, d), "tile", "city"), ["mae", "rmse"], "city")


@query(f"WITH {_PAIRS} SELECT cls, {ERRORS} FROM p GROUP BY cls")
def d07_by_raw_class(spark, d):
    return metrics.pooled_metrics(_pairs(spark, d), "cls")


@query(f"WITH {LI} SELECT split, o AS over, {ERRORS} FROM li, (VALUES (1.0::DOUBLE), (5.0::DOUBLE), (30.0::DOUBLE)) b(o) WHERE truth > o GROUP BY ALL")
def d10_threshold_bands(spark, d):
    return metrics.threshold_bands(fx.metric_pairs(spark, d), [1, 5, 30], "split")


@query(f"""WITH {EV}, t AS (SELECT s, avg((cls = 6)::INT) AS b, avg((cls = 5)::INT) AS v, quantile_cont(z, 0.95) FILTER (NOT isnan(z) AND z <> -9999) - quantile_cont(z, 0.5) FILTER (NOT isnan(z) AND z <> -9999) AS rel FROM ev GROUP BY s)
SELECT s AS scene_id, round(b, 6) AS building_share, round(v, 6) AS vegetation_share, round(rel, 6) AS relief, CASE WHEN b >= 0.15 THEN 'urban' WHEN v >= 0.5 THEN 'forest' WHEN rel >= 15 THEN 'hilly' WHEN b >= 0.02 THEN 'sparse' ELSE 'flat' END AS scene_type FROM t""")
def d11_scene_type(spark, d):
    return metrics.scene_type(fx.pixels(spark, d))


_Q = ", ".join(f"round(quantile_cont(z, {x / 100}), 6) AS p{str(x).replace('.', '_')}" for x in (1, 5, 25, 50, 75, 95, 99, 99.9))


@query(f"WITH {EV} SELECT s AS scene_id, count(*) AS n, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, {_Q} FROM ok GROUP BY s")
def d19_distribution(spark, d):
    return metrics.distribution(_ok(spark, d), "z", "scene_id")


@query(f"WITH {EV} SELECT s AS scene_id, cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY s), 6) AS share FROM ev GROUP BY s, cls")
def d25_class_inventory(spark, d):
    return metrics.class_inventory(fx.pixels(spark, d), "scene_id")


@query(f"WITH {LI} SELECT split, count(*) AS n, round(regr_slope(truth, pred), 6) AS a, round(regr_intercept(truth, pred), 6) AS b FROM li GROUP BY split")
def d26_fit_affine(spark, d):
    return metrics.fit_affine(fx.metric_pairs(spark, d), "split")


@query()
def d27_fit_affine_huber(spark, d):
    a, b = metrics.fit_affine_huber(fx.metric_pairs(spark, d))
    return spark.createDataFrame([(a, b)], "a double, b double")


@query(f"""WITH {LI}, f AS (SELECT avg(truth) AS m, median(truth) AS md FROM li WHERE split = 'A'), g AS (SELECT 'zero' AS baseline, 0.0::DOUBLE AS pred UNION ALL SELECT 'mean', m FROM f UNION ALL SELECT 'median', md FROM f),
p AS (SELECT baseline, split, g.pred, truth FROM li, g) SELECT baseline, split, {ERRORS} FROM p GROUP BY ALL""")
def d28_constant_baselines(spark, d):
    return metrics.constant_baselines(fx.metric_pairs(spark, d), "A")


@query(f"WITH {LI}, m AS (SELECT split AS key, avg(abs(pred - truth)) AS value FROM li GROUP BY ALL) SELECT key, round(value, 6) AS value, must, target, coalesce(value < must, false) AS passes, coalesce(value <= target, false) AS on_target FROM (VALUES ('A', 20.0::DOUBLE, 10.0::DOUBLE), ('N', 15.0::DOUBLE, 30.0::DOUBLE), ('X', 1.0::DOUBLE, 1.0::DOUBLE)) g(key, must, target) LEFT JOIN m USING (key)")
def d30_gate_verdicts(spark, d):
    gates = spark.createDataFrame([("A", 20.0, 10.0), ("N", 15.0, 30.0), ("X", 1.0, 1.0)], "key string, must double, target double")
    m = metrics.pooled_metrics(fx.metric_pairs(spark, d), "split").select(F.col("split").alias("key"), F.col("mae").alias("value"))
    return metrics.gate_verdicts(m, gates)


@query(f"WITH {_PAIRS} SELECT scene_id, round(avg((pred <= 1e-6)::INT), 6) AS pred_zero, round(avg((truth <= 0.5)::INT), 6) AS truth_low FROM p GROUP BY ALL")
def d34_saturation(spark, d):
    return metrics.saturation(_pairs(spark, d), "scene_id")


@query(f"WITH {EV}, v AS (SELECT s, r, c, z FROM ok UNION ALL SELECT s, r, 39 - c, z FROM ok UNION ALL SELECT s, 24 - r, c, z FROM ok) SELECT s AS scene_id, r AS \"row\", c AS col, round(median(z), 6) AS z_median, round(avg(z), 6) AS z_mean, round(stddev_pop(z), 6) AS spread FROM v GROUP BY ALL")
def d39_tta_fuse(spark, d):
    px = _ok(spark, d).select("scene_id", "row", "col", "z")
    return metrics.tta_fuse(pixels.union_all([px, *(pixels.flip_rotate(px, k, fx.HEIGHT, fx.WIDTH) for k in ("hflip", "vflip"))]))


@query(f"WITH {LI}, e AS (SELECT split, abs(pred - truth) AS e, CASE WHEN truth > 30 THEN 5.0 WHEN truth > 10 THEN 2.0 ELSE 1.0 END AS w FROM li) SELECT split, round(avg(e), 6) AS l1, round(avg(CASE WHEN e <= 1 THEN e * e / 2 ELSE e - 0.5 END), 6) AS huber, round(sum(w * e) / sum(w), 6) AS balanced FROM e GROUP BY split")
def d43_losses(spark, d):
    return metrics.losses(fx.metric_pairs(spark, d), "split")


@query(f"WITH {LI} SELECT CASE grouping(split, city, cls) WHEN 7 THEN 'all' WHEN 3 THEN 'split' WHEN 5 THEN 'city' ELSE 'class' END AS level, CASE grouping(split, city, cls) WHEN 3 THEN split WHEN 5 THEN city WHEN 6 THEN cls::VARCHAR END AS key, {ERRORS} FROM li GROUP BY GROUPING SETS ((), (split), (city), (cls))")
def d45_rollup_report(spark, d):
    return metrics.rollup_report(fx.metric_pairs(spark, d))


# --- E: focal -----------------------------------------------------------------------------------------------------

_CL = f"{EV}, k AS (SELECT s, r, c, truth AS z, cls FROM ev)"


def _smooth(spark, d) -> DataFrame:
    return fx.pixels(spark, d).select("scene_id", "row", "col", F.col("truth").alias("z"), "cls")


_GRAD = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({b} - {a}) / 2 WHEN {b} IS NOT NULL THEN {b} - z WHEN {a} IS NOT NULL THEN z - {a} ELSE 0 END"
_SLOPE = f"{_CL}, nb AS (SELECT *, lag(z) OVER (PARTITION BY s, c ORDER BY r) AS u, lead(z) OVER (PARTITION BY s, c ORDER BY r) AS o, lag(z) OVER (PARTITION BY s, r ORDER BY c) AS l, lead(z) OVER (PARTITION BY s, r ORDER BY c) AS g FROM k), gr AS (SELECT *, {_GRAD.format(a='u', b='o')} AS gy, {_GRAD.format(a='l', b='g')} AS gx FROM nb)"


@query(f"WITH {_SLOPE} SELECT s AS scene_id, r AS \"row\", c AS col, round(degrees(atan(sqrt((gy / 0.5) ** 2 + (gx / 0.5) ** 2))), 6) AS slope FROM gr")
def e01_slope_deg(spark, d):
    return focal.slope_deg(_smooth(spark, d), 0.5)


_NEAR = "FROM k a JOIN k b ON a.s = b.s AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.s, a.r, a.c"


@query(f"WITH {_CL} SELECT a.s AS scene_id, a.r AS \"row\", a.c AS col, round(max(b.z) - min(b.z), 6) AS step {_NEAR}")
def e02_step_height(spark, d):
    return focal.step_height(_smooth(spark, d))


@query(f"""WITH {_CL}, o AS (SELECT a.s, a.r, a.c, greatest(0, least({fx.HEIGHT - 1}, a.r + y.d)) AS nr, greatest(0, least({fx.WIDTH - 1}, a.c + x.d)) AS nc FROM k a, (SELECT unnest(range(-2, 3)) AS d) y, (SELECT unnest(range(-2, 3)) AS d) x)
SELECT o.s AS scene_id, o.r AS "row", o.c AS col, round(stddev_pop(b.z), 6) AS rough FROM o JOIN k b ON b.s = o.s AND b.r = o.nr AND b.c = o.nc GROUP BY ALL""")
def e03_roughness(spark, d):
    return focal.roughness(_smooth(spark, d))


@query(f"""WITH {_CL}, m AS (SELECT a.s, a.r, a.c, a.z, max(b.z) AS top FROM k a JOIN k b ON a.s = b.s AND abs(a.r - b.r) <= 12 AND abs(a.c - b.c) <= 12 GROUP BY ALL)
SELECT s AS scene_id, r AS "row", c AS col, round(z, 6) AS z FROM m WHERE z = top""")
def e23_local_maxima(spark, d):
    return focal.local_maxima(_smooth(spark, d)).select("scene_id", "row", "col", "z")


@query(f"WITH {EV}, k AS (SELECT s, r, c, z FROM ev), v AS (SELECT a.s, a.r, a.c, list(b.z) FILTER (NOT isnan(b.z)) AS zs {_NEAR}), m AS (SELECT *, list_median(zs) AS md FROM v) SELECT s AS scene_id, r AS \"row\", c AS col, round(md, 6) AS median, round(list_median(list_transform(zs, lambda x: abs(x - md))), 6) AS mad FROM m")
def e08_median_mad(spark, d):
    return focal.median_mad(fx.pixels(spark, d).select("scene_id", "row", "col", "z")).select("scene_id", "row", "col", "median", "mad")


_MASK = f"{EV}, k AS (SELECT s, r, c, (cls = 6)::INT AS z FROM ev)"


@query(f"WITH {_MASK}, o AS (SELECT a.s, a.r, a.c, max(b.z) AS z {_NEAR}), e AS (SELECT a.s, a.r, a.c, CASE WHEN count(*) = 9 THEN min(b.z) ELSE 0 END AS z {_NEAR.replace('FROM k a JOIN k b', 'FROM o a JOIN o b')}) SELECT s AS scene_id, sum(z)::BIGINT AS n FROM e GROUP BY s")
def e12_closing(spark, d):
    mask = fx.pixels(spark, d).select("scene_id", "row", "col", (F.col("cls") == 6).cast("int").alias("m"))
    return focal.closing(mask, fx.HEIGHT, fx.WIDTH).groupBy("scene_id").agg(F.sum("m").alias("n"))


@query(f"WITH {_CL}, e AS (SELECT a.s, a.r, a.c, max((a.cls <> b.cls)::INT) AS m FROM k a JOIN k b ON a.s = b.s AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL) SELECT s AS scene_id, sum(m)::BIGINT AS n FROM e GROUP BY s")
def e13_class_edges(spark, d):
    return focal.class_edges(_smooth(spark, d)).groupBy("scene_id").agg(F.sum("m").alias("n"))


@query(f"WITH {_CL} SELECT s AS scene_id, r // 4 AS \"row\", c // 4 AS col, round(avg(z), 6) AS z FROM k WHERE r < 24 GROUP BY ALL")
def e24_block_mean(spark, d):
    return focal.block_mean(_smooth(spark, d), 4, fx.HEIGHT, fx.WIDTH)


@query(f"""WITH {_CL}, j AS (SELECT a.s, 'c' AS way, a.c AS k, avg(abs(a.z - b.z)) AS jump FROM k a JOIN k b ON a.s = b.s AND a.r = b.r AND b.c = a.c - 1 WHERE a.c % 8 = 0 GROUP BY ALL
UNION ALL SELECT a.s, 'r', a.r, avg(abs(a.z - b.z)) FROM k a JOIN k b ON a.s = b.s AND a.c = b.c AND b.r = a.r - 1 WHERE a.r % 8 = 0 GROUP BY ALL) SELECT s AS scene_id, round(avg(jump), 6) AS seam_error, count(*) AS n_seams FROM j GROUP BY s""")
def d17_seam_error(spark, d):
    return focal.seam_error(_smooth(spark, d), 8)


# --- F: tiling ----------------------------------------------------------------------------------------------------

_W = f"{EV}, sc AS (SELECT DISTINCT s FROM ev), wr(ri, ro) AS (VALUES (0, 0), (1, 8), (2, 9)), wc(ci, co) AS (VALUES (0, 0), (1, 8), (2, 16), (3, 24))"


@query(f"WITH {_W} SELECT s AS scene_id, ri, ci, ro AS row_off, co AS col_off, 16 AS valid_h, 16 AS valid_w FROM sc, wr, wc")
def f01_tile_windows(spark, d):
    return tiling.tile_windows(fx.scenes(spark, d), 16, 8)


@query(f"WITH {EV} SELECT s AS scene_id, r AS \"row\", c AS col, round(truth, 6) AS z FROM ev")
def f04_stitch(spark, d):
    """Tiling and stitching gives the input back."""
    return tiling.stitch(tiling.tile_pixels(_smooth(spark, d), fx.scenes(spark, d), 16, 8), 16, 8)


@query(f"WITH {_W} SELECT s AS scene_id, ri, ci, count(*) AS n, round(avg(truth), 6) AS mean FROM ev, wr, wc WHERE r BETWEEN ro AND ro + 15 AND c BETWEEN co AND co + 15 GROUP BY ALL")
def f02_tile_pixels(spark, d):
    t = tiling.tile_pixels(_smooth(spark, d), fx.scenes(spark, d), 16, 8)
    return t.groupBy("scene_id", "ri", "ci").agg(F.count("*").alias("n"), F.avg("z").alias("mean"))


@query(f"WITH {EV} SELECT r AS \"row\", c + 40 * s AS col, round(avg(z), 6) AS z, count(*) AS n FROM ok GROUP BY ALL")
def f08_mosaic(spark, d):
    return tiling.mosaic(fx.pixels(spark, d), fx.scenes(spark, d))


@query(f"WITH {EV} SELECT s AS scene_id, ty, tx, least(16, 25 - ty * 16) AS h, least(16, 40 - tx * 16) AS w FROM (SELECT DISTINCT s FROM ev), (VALUES (0), (1)) a(ty), (VALUES (0), (1), (2)) b(tx)")
def f09_tile_grid(spark, d):
    return tiling.tile_grid(fx.scenes(spark, d), 16)


@query(f"""WITH {EV}, k AS (SELECT s, x, y, round_even(y * 25 / 4.0, 0)::INT AS r0, round_even((y + 1) * 25 / 4.0, 0)::INT AS r1, round_even(x * 40 / 4.0, 0)::INT AS c0, round_even((x + 1) * 40 / 4.0, 0)::INT AS c1 FROM (SELECT DISTINCT s FROM ev), (VALUES (0), (1), (2), (3)) a(x), (VALUES (0), (1), (2), (3)) b(y))
SELECT s AS scene_id, 2 AS z, x, y, r0 AS row0, c0 AS col0, greatest(1, r1 - r0) AS h, greatest(1, c1 - c0) AS w FROM k""")
def f10_quadtree_window(spark, d):
    return tiling.quadtree_window(fx.scenes(spark, d), 2)


# --- G: components ------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EV}, m AS (SELECT s, r, c, s * 1000 + r * 40 + c AS id FROM ev WHERE cls IN (2, 6)),
e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON a.s = b.s AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
w(id, lab) AS (SELECT id, id FROM m UNION SELECT e.v, w.lab FROM w JOIN e ON e.u = w.id WHERE w.lab < e.v)
SELECT lab // 1000 AS scene_id, lab AS label, count(*) AS area FROM (SELECT id, min(lab) AS lab FROM w GROUP BY id) GROUP BY ALL HAVING count(*) >= 2""")
def g01_label_components(spark, d):
    """The components of g01_all_components with at least two pixels."""
    return _components(spark, d).where("area >= 2")


@query(f"""WITH RECURSIVE {EV}, m AS (SELECT s, r, c, s * 1000 + r * 40 + c AS id FROM ev WHERE cls IN (2, 6)),
e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON a.s = b.s AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
w(id, lab) AS (SELECT id, id FROM m UNION SELECT e.v, w.lab FROM w JOIN e ON e.u = w.id WHERE w.lab < e.v)
SELECT lab // 1000 AS scene_id, lab AS label, count(*) AS area FROM (SELECT id, min(lab) AS lab FROM w GROUP BY id) GROUP BY ALL""")
def g01_all_components(spark, d):
    """All 4-connected components of two classes, single pixels too, labelled by their smallest pixel, with their area."""
    return _components(spark, d)


def _components(spark, d) -> DataFrame:
    m = fx.pixels(spark, d).where(F.col("cls").isin(2, 6)).select("scene_id", "row", "col", (F.col("scene_id") * 1000 + F.col("row") * 40 + F.col("col")).alias("id"))
    right, down = Window.partitionBy("scene_id", "row").orderBy("col"), Window.partitionBy("scene_id", "col").orderBy("row")
    links = m.select("id", F.array(F.when(F.lead("col").over(right) == F.col("col") + 1, F.lead("id").over(right)), F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("id").over(down))).alias("next"))
    edges = links.select(F.col("id").alias("u"), F.explode("next").alias("v")).where("v is not null")
    # a pixel without an edge is a component of its own
    labels = m.select(F.col("id").alias("node")).distinct().join(connected_components(edges), "node", "left").select(F.coalesce("component", "node").alias("label"))
    return labels.groupBy(F.floor(F.col("label") / 1000).alias("scene_id"), "label").agg(F.count("*").alias("area"))


# --- H: splits ----------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT split, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM orders) GROUP BY split), s AS (SELECT split, n, n / sum(n) OVER () AS share FROM t)
SELECT split, n, round(share, 6) AS share, abs(share - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) > 0.05 AS off_target FROM s""")
def h03_split_report(spark, d):
    k = F.col("o_orderkey") % 10
    s = fx.table(spark, d, "orders").select(F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("split"))
    return splits.split_report(s, {"train": 0.7, "val": 0.15, "test": 0.15})


@query(f"""WITH {_STEMS}, p AS (SELECT split_part(stem, '_', 1) AS city, split_part(stem, '_', 2)::INT AS "row" FROM st WHERE stem LIKE '%\\_%' ESCAPE '\\'),
n AS (SELECT city, "row", count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT city, "row", sum(n) OVER (PARTITION BY city ORDER BY "row") AS u, row_number() OVER (PARTITION BY city ORDER BY "row") AS k, sum(n) OVER (PARTITION BY city) AS t, count(*) OVER (PARTITION BY city) AS m FROM n),
c AS (SELECT a.city, a.k AS i, b.k AS j, round(abs(a.u / a.t - 0.7) + abs((b.u - a.u) / a.t - 0.15) + abs(1 - b.u / a.t - 0.15), 9) AS loss FROM k a JOIN k b ON a.city = b.city AND a.k < b.k AND b.k < b.m WHERE a.m >= 3),
x AS (SELECT city, i, j FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY loss, i, j) AS q FROM c) WHERE q = 1)
SELECT city, "row", CASE WHEN i IS NULL OR k <= i THEN 'train' WHEN k <= j THEN 'val' ELSE 'test' END AS split FROM k LEFT JOIN x USING (city)""")
def h01_block_split(spark, d):
    return splits.block_split(splits.parse_stem(_stems(spark, d).select("stem")).where("ok").select("city", "row"))


# --- J: jobs ------------------------------------------------------------------------------------------------------

_STATE = f"""{JOBS}, l AS (SELECT job_id, min((ts, event_id)) FILTER (status IN ('completed', 'failed')) AS lk FROM j GROUP BY job_id),
kn AS (SELECT j.* FROM j JOIN l USING (job_id) WHERE lk IS NULL OR (ts, event_id) <= lk), stt AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id, count(*) FILTER (status = 'processing') AS attempts FROM kn GROUP BY job_id)"""


@query(f"WITH {_STATE} SELECT * FROM stt")
def j02_job_state(spark, d):
    return jobs.job_state(fx.job_events(spark, d))


@query(f"WITH {JOBS} SELECT scene_id, arg_max(job_id, (ts, event_id)) AS job_id, arg_max(status, (ts, event_id)) AS status FROM j GROUP BY scene_id")
def j05_active_job(spark, d):
    return jobs.active_job(fx.job_events(spark, d))


@query(f"WITH {JOBS} SELECT job_id, arg_min(event_id, (ts, event_id)) AS event_id FROM j WHERE status = 'processing' GROUP BY job_id")
def j06_first_claim(spark, d):
    return jobs.first_claim(fx.job_events(spark, d))


@query(f"WITH {JOBS} SELECT job_id, arg_max(status, (ts, event_id)) AS status, count(*) AS n_events FROM j GROUP BY job_id")
def j08_stage_progress(spark, d):
    return jobs.stage_progress(fx.job_events(spark, d))
