"""Registered queries of reports, listings, samples and job retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import joins, listings, metrics, pixels, reports, sampling, tiling
from gridspark.plans.map_queries import RC, soft
from gridspark.plans.registry import _STEMS, _W, ERRORS, EV, JOBS, LI, _ok, _pairs, _smooth, _stems, query
from gridspark.sources import fixtures as fx
from gridspark.streaming import jobs

LEGEND = "lg(cls, project_cls) AS (VALUES (2, 4), (5, 1), (6, 0), (9, 3))"
TW = f"{EV}, tw AS (SELECT s, r, c, cls, truth, truth * 0.9 + (r + c) / 10.0::DOUBLE AS pred FROM ev)"
_WIN = "WINDOW wr AS (PARTITION BY s, c ORDER BY r), wc AS (PARTITION BY s, r ORDER BY c)"
_INNER = f"""{TW}, g0 AS (SELECT s, r, c, (lead(pred) OVER wr - lag(pred) OVER wr) / 2 AS gyp, (lead(truth) OVER wr - lag(truth) OVER wr) / 2 AS gyt, (lead(pred) OVER wc - lag(pred) OVER wc) / 2 AS gxp, (lead(truth) OVER wc - lag(truth) OVER wc) / 2 AS gxt FROM tw {_WIN}),
g AS (SELECT * FROM g0 WHERE gyp IS NOT NULL AND gxp IS NOT NULL)"""


def legend(spark) -> DataFrame:
    return spark.createDataFrame([(2, 4), (5, 1), (6, 0), (9, 3)], "cls int, project_cls int")


def two(spark, d) -> DataFrame:
    """Finite pairs on every pixel."""
    px = fx.pixels(spark, d)
    return px.select("scene_id", "row", "col", "cls", "truth", (F.col("truth") * 0.9 + (F.col("row") + F.col("col")) / 10.0).alias("pred"))


@query(f"""WITH {EV}, st AS (SELECT s, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM ok GROUP BY s)
SELECT {RC}, round(CASE WHEN isnan(z) OR z = -9999 OR hi <= lo THEN 0 ELSE least(greatest((z - lo) / (hi - lo), 0), 1) END, 6) AS unit, round_even(CASE WHEN isnan(z) OR z = -9999 OR hi <= lo THEN 0 ELSE least(greatest((z - lo) / (hi - lo), 0), 1) END * 255, 0)::INT AS u8 FROM ev JOIN st USING (s)""")
def b10_stretch_filled(spark, d):
    """Values that are not finite and flat scenes are 0."""
    px = pixels.stretch_to_01(fx.pixels(spark, d), nodata=fx.NODATA, flat=0.0, fill=0.0)
    return px.select("scene_id", "row", "col", "unit", pixels.quantize(F.col("unit")).alias("u8"))


@query(f"WITH {EV} SELECT s AS scene_id, count(*) AS n, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(max(z) - min(z), 6) AS relief, count(*) FILTER (z < 0) AS n_negative FROM ok GROUP BY s")
def d02_array_stats(spark, d):
    return reports.array_stats(_ok(spark, d), "scene_id")


@query(f"WITH {EV}, {LEGEND} SELECT s AS scene_id, project_cls, count(*) AS n, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(max(z) - min(z), 6) AS relief, count(*) FILTER (z < 0) AS n_negative FROM ok JOIN lg USING (cls) GROUP BY ALL")
def d03_scene_stats(spark, d):
    """Statistics of each scene by project class."""
    mapped, _ = pixels.map_classes(_ok(spark, d), legend(spark))
    return reports.array_stats(mapped.where("project_cls <> 255"), "scene_id", "project_cls")


@query(f"WITH {EV}, {LEGEND}, p AS (SELECT project_cls, z AS pred, truth FROM ok JOIN lg USING (cls)) SELECT project_cls, {ERRORS} FROM p GROUP BY project_cls")
def d08_by_project_class(spark, d):
    return reports.by_project_class(_pairs(spark, d), legend(spark))


@query(f"""WITH {LI}, p AS (SELECT city, round(avg(abs(pred - truth)), 6) AS pooled_mae, round(sqrt(avg((pred - truth) ** 2)), 6) AS pooled_rmse FROM li GROUP BY city), t AS (SELECT tile, city, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) ** 2)) AS rmse FROM li GROUP BY ALL)
SELECT city, pooled_mae, pooled_rmse, round(avg(mae), 6) AS mae_mean, round(avg(rmse), 6) AS rmse_mean, count(*) AS n_tiles FROM t JOIN p USING (city) GROUP BY ALL""")
def d09_by_city(spark, d):
    return reports.by_city(fx.metric_pairs(spark, d))


_TYPES = f"""{EV}, {LEGEND}, ty AS (SELECT s, avg((project_cls = 0)::INT) AS b, avg((project_cls = 1)::INT) AS v, CASE WHEN count(z) FILTER (NOT isnan(z)) > 10 THEN quantile_cont(z, 0.95) FILTER (NOT isnan(z)) - quantile_cont(z, 0.5) FILTER (NOT isnan(z)) ELSE 0 END AS rel FROM ev LEFT JOIN lg USING (cls) GROUP BY s),
kd AS (SELECT *, CASE WHEN b IS NULL THEN 'flat' WHEN b >= 0.15 THEN 'urban' WHEN v >= 0.5 THEN 'forest' WHEN rel >= 15 THEN 'hilly-high-relief' WHEN b >= 0.02 THEN 'sparse-suburban' ELSE 'flat' END AS kind FROM ty)"""


@query(f"WITH {_TYPES} SELECT s AS scene_id, round(b, 6) AS building_share, round(v, 6) AS vegetation_share, round(rel, 6) AS relief, kind AS scene_type FROM kd")
def d11_scene_type_labelled(spark, d):
    """Shares among labelled pixels of project classes."""
    return reports.scene_type_labelled(fx.pixels(spark, d), legend(spark))


@query(f"WITH {_TYPES}, m AS (SELECT s, avg(abs(z - truth)) AS mae, avg(z - truth) AS bias FROM ok GROUP BY s) SELECT kind AS scene_type, round(avg(mae), 6) AS mae_mean, round(avg(bias), 6) AS bias_mean, count(*) AS n_tiles FROM m JOIN kd USING (s) GROUP BY kind")
def d12_by_scene_type(spark, d):
    types = reports.scene_type_labelled(fx.pixels(spark, d), legend(spark))
    return reports.by_scene_type(metrics.pooled_metrics(_pairs(spark, d), "scene_id"), types, ["mae", "bias"])


_SL = "degrees(atan(sqrt((gyp / 0.5) ** 2 + (gxp / 0.5) ** 2))) - degrees(atan(sqrt((gyt / 0.5) ** 2 + (gxt / 0.5) ** 2)))"


@query(f"WITH {_INNER}, e AS (SELECT s, {_SL} AS d FROM g) SELECT s AS scene_id, count(*) AS n, round(avg(abs(d)), 6) AS slope_mae_deg, round(sqrt(avg(d * d)), 6) AS slope_rmse_deg, round(avg(d), 6) AS slope_bias_deg FROM e GROUP BY s")
def d13_slope_error(spark, d):
    return reports.slope_error(two(spark, d), 0.5)


@query(f"WITH {_INNER}, e AS (SELECT s, (abs(gyp - gyt) + abs(gxp - gxt)) / 2 AS d FROM g) SELECT s AS scene_id, count(*) AS n, round(avg(d), 6) AS grad_mae, round(sqrt(avg(d * d)), 6) AS grad_rmse FROM e GROUP BY s")
def d14_gradient_error(spark, d):
    return reports.gradient_error(two(spark, d))


_BANDS = f"""{TW}, ed AS (SELECT a.s, a.r, a.c, max((a.cls <> b.cls)::INT) AS e, max((b.cls = 6)::INT) AS tb, max((b.cls = 2)::INT) AS ot FROM tw a JOIN tw b ON a.s = b.s AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
bd AS (SELECT a.s, a.r, a.c, max(b.e) = 1 AS any_band, max(b.e * b.tb) = 1 AS building_band, max(b.e * b.tb) = 1 AND max(b.ot) = 1 AS building_other FROM ed a JOIN ed b ON a.s = b.s AND abs(a.r - b.r) + abs(a.c - b.c) <= 2 GROUP BY ALL)"""


@query(f"WITH {_BANDS} SELECT {RC}, any_band, building_band, building_other FROM bd")
def e13_boundary_bands(spark, d):
    """Every pixel with its three marks."""
    from gridspark.operators import focal

    return focal.boundary_bands(two(spark, d), 6, 2, 2).select("scene_id", "row", "col", "any_band", "building_band", "building_other")


@query(f"""WITH {_BANDS}, p AS (SELECT 'any_band' AS band, pred, truth FROM tw JOIN bd USING (s, r, c) WHERE any_band UNION ALL SELECT 'building_band', pred, truth FROM tw JOIN bd USING (s, r, c) WHERE building_band UNION ALL SELECT 'building_other', pred, truth FROM tw JOIN bd USING (s, r, c) WHERE building_other)
SELECT band, {ERRORS} FROM p GROUP BY band""")
def d15_boundary_metrics(spark, d):
    return reports.boundary_metrics(two(spark, d), 6, 2, 2)


@query(f"""WITH {TW}, j AS (SELECT a.s, abs(a.pred - b.pred) AS p, abs(a.truth - b.truth) AS t FROM tw a JOIN tw b ON a.s = b.s AND ((a.r = b.r + 1 AND a.c = b.c) OR (a.c = b.c + 1 AND a.r = b.r)) WHERE a.cls IN (6, 9) AND b.cls IN (6, 9))
SELECT s AS scene_id, count(*) AS n_pairs, round(sum(p) / sum(t), 6) AS jump_ratio FROM j WHERE t > 2 GROUP BY s""")
def d16_jump_ratio(spark, d):
    return reports.jump_ratio(two(spark, d).withColumn("band", F.col("cls").isin(6, 9)))


@query(f"WITH {LI}, t AS (SELECT tile, split, avg(abs(pred - truth)) AS mae, CASE WHEN count(*) > 1 AND stddev_pop(pred) > 1e-9 AND stddev_pop(truth) > 1e-9 THEN corr(pred, truth) END AS r FROM li GROUP BY ALL), l AS (SELECT split, 'mae' AS key, mae AS value FROM t UNION ALL SELECT split, 'r', r FROM t) SELECT split, key, round(avg(value), 6) AS mean, count(value) AS n FROM l GROUP BY ALL")
def d18_tile_metric_summary(spark, d):
    m = metrics.pooled_metrics(fx.metric_pairs(spark, d), "tile", "split")
    return reports.tile_metric_summary(reports.long_metrics(m, {"mae": "mae", "r": "r"}, "split"), "split")


_FULLG = "coalesce((lead({c}) OVER {w} - lag({c}) OVER {w}) / 2, lead({c}) OVER {w} - {c}, {c} - lag({c}) OVER {w}, 0)"


@query(f"""WITH {TW}, g AS (SELECT s, abs(pred - truth) AS d, sqrt(({_FULLG.format(c='truth', w='wr')}) ** 2 + ({_FULLG.format(c='truth', w='wc')}) ** 2) AS gr, sqrt(({_FULLG.format(c='pred', w='wr')}) ** 2 + ({_FULLG.format(c='pred', w='wc')}) ** 2) AS gf FROM tw {_WIN}),
l AS (SELECT s, quantile_cont(gr, 0.95) AS lim FROM g GROUP BY s)
SELECT s AS scene_id, count(*) AS n, round(avg((d > 1e-4)::INT) * 100, 6) AS changed_percent, round(avg(d), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(max(d), 6) AS max_ae, round(median(d), 6) AS medae, round(quantile_cont(d, 0.95), 6) AS p95_ae, round(quantile_cont(d, 0.99), 6) AS p99_ae, round(coalesce(avg(gf) FILTER (gr > lim) / avg(gr) FILTER (gr > lim), 1), 6) AS edge_preservation FROM g JOIN l USING (s) GROUP BY s""")
def d20_before_after(spark, d):
    return reports.before_after(two(spark, d).select("scene_id", "row", "col", F.col("truth").alias("raw"), F.col("pred").alias("refined")))


@query(f"""WITH {TW}, q AS (SELECT s, avg(truth) AS a, median(truth) AS b, stddev_pop(truth) AS c, avg(pred) AS e, median(pred) AS f, stddev_pop(pred) AS g FROM tw GROUP BY s)
SELECT s AS scene_id, round(a, 6) AS raw_mean, round(b, 6) AS raw_median, round(c, 6) AS raw_std, round(e, 6) AS refined_mean, round(f, 6) AS refined_median, round(g, 6) AS refined_std, round(e - a, 6) AS mean_shift, round(f - b, 6) AS median_shift, round(g / c, 6) AS std_ratio FROM q""")
def d21_calibration_report(spark, d):
    return reports.calibration_report(two(spark, d).select("scene_id", F.col("truth").alias("raw"), F.col("pred").alias("refined")), "scene_id")


_RULE = ", ".join(f"('{k}', '{kind}', {t}::DOUBLE)" for k, kind, t in reports.RULES)
_ACC = """ru(key, kind, tolerance) AS (VALUES {rules}), a0 AS (SELECT vv.variant, vv.key, kind, tolerance, c.value AS got, b.value AS base FROM (SELECT * FROM (SELECT DISTINCT variant FROM cand), ru) vv LEFT JOIN cand c ON c.variant = vv.variant AND c.key = vv.key LEFT JOIN cand b ON b.variant = 'A' AND b.key = vv.key),
a1 AS (SELECT *, got IS NULL OR (kind <> 'shift' AND base IS NULL) OR (kind = 'relative' AND coalesce(base <= 0, false)) AS skipped, CASE kind WHEN 'absolute' THEN got <= base + tolerance WHEN 'magnitude' THEN abs(got) <= abs(base) + tolerance WHEN 'relative' THEN got <= base * (1 + tolerance) ELSE abs(got) <= tolerance END AS fine FROM a0)""".format(rules=_RULE)
_CAND = f"{LI}, m AS (SELECT split AS variant, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) ** 2)) AS rmse, avg(pred - truth) AS bias, avg((pred < 0)::INT) AS neg FROM li GROUP BY split), cand AS (SELECT variant, 'mae' AS key, mae AS value FROM m UNION ALL SELECT variant, 'rmse', rmse FROM m UNION ALL SELECT variant, 'bias', bias FROM m UNION ALL SELECT variant, 'negative_fraction', neg FROM m UNION ALL SELECT variant, 'calibration_mean_shift', bias / 1000 FROM m)"


def _candidates(spark, d) -> DataFrame:
    m = metrics.pooled_metrics(fx.metric_pairs(spark, d), "split").withColumn("shift", F.col("bias") / 1000).withColumnRenamed("split", "variant")
    return reports.long_metrics(m, {"mae": "mae", "rmse": "rmse", "bias": "bias", "neg_frac": "negative_fraction", "shift": "calibration_mean_shift"}, "variant")


@query(f"WITH {_CAND}, {_ACC} SELECT variant, key, round(got, 6) AS got, round(base, 6) AS base, tolerance, skipped, skipped OR coalesce(fine, false) AS pass FROM a1")
def d22_acceptance(spark, d):
    c = _candidates(spark, d)
    return reports.acceptance(c.where("variant = 'A'").select("key", "value"), c)


@query(f"""WITH l0 AS (SELECT l_suppkey AS tile, l_returnflag AS variant, l_extendedprice / 1000 AS pred, l_quantity AS truth FROM lineitem), li AS (SELECT * FROM l0 WHERE tile IN (SELECT tile FROM l0 WHERE variant = 'A')),
m AS (SELECT variant, {ERRORS}, avg(abs(pred - truth)) AS mae_, sqrt(avg((pred - truth) ** 2)) AS rmse_, avg(pred - truth) AS bias_, avg((pred < 0)::INT) AS neg_ FROM li GROUP BY variant),
cand AS (SELECT variant, 'mae' AS key, mae_ AS value FROM m UNION ALL SELECT variant, 'rmse', rmse_ FROM m UNION ALL SELECT variant, 'bias', bias_ FROM m UNION ALL SELECT variant, 'negative_fraction', neg_ FROM m), {_ACC},
v AS (SELECT variant, CASE WHEN bool_and(skipped OR coalesce(fine, false)) THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) FILTER (NOT (skipped OR coalesce(fine, false))) AS n_failed, count(*) FILTER (skipped) AS n_skipped FROM a1 GROUP BY variant)
SELECT variant, n, mae, rmse, bias, r, neg_frac, verdict, n_failed, n_skipped FROM m JOIN v USING (variant)""")
def d23_ablation_table(spark, d):
    return reports.ablation_table(fx.metric_pairs(spark, d), "split", "A")


@query(f"""WITH {EV}, m AS (SELECT cls, s, avg(z) AS m FROM ok GROUP BY ALL) SELECT cls, count(*) AS n, round(min(z), 6) AS lo, round(max(z), 6) AS hi, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, round(median(z), 6) AS p50, round(quantile_cont(z, 0.95), 6) AS p95, round(quantile_cont(z, 0.99), 6) AS p99, round(avg((truth > 50)::INT), 6) AS ignore_frac, round((SELECT stddev_pop(m) FROM m WHERE m.cls = ok.cls), 6) AS tile_mean_spread FROM ok GROUP BY cls""")
def d24_dataset_stats(spark, d):
    return reports.dataset_stats(_ok(spark, d).withColumn("ignored", F.col("truth") > 50), "cls")


@query(f"""WITH {LI}, f AS (SELECT avg(truth) AS m, median(truth) AS md FROM li WHERE split = 'A'), g AS (SELECT 'zero' AS baseline, 0.0::DOUBLE AS pred UNION ALL SELECT 'mean', m FROM f UNION ALL SELECT 'median', md FROM f),
p AS (SELECT baseline, split, avg(abs(g.pred - truth)) AS mae, sqrt(avg((g.pred - truth) ** 2)) AS rmse FROM li, g GROUP BY ALL)
SELECT split, round(min(mae), 6) AS mae_must, arg_min(baseline, (mae, baseline)) AS mae_from, round(min(rmse), 6) AS rmse_must, arg_min(baseline, (rmse, baseline)) AS rmse_from, round(min(mae) * 0.8, 3) AS mae_target, round(min(rmse) * 0.9, 3) AS rmse_target FROM p GROUP BY split""")
def d29_reference_card(spark, d):
    return reports.reference_card(metrics.constant_baselines(fx.metric_pairs(spark, d), "A"), "split")


_COV = f"{TW}, cv AS (SELECT s, count(*) AS nr, count(*) FILTER (c < 30 AND s % 7 <> 6) AS no FROM ok GROUP BY s)"


def _candidate(spark, d) -> DataFrame:
    return two(spark, d).where("col < 30 and scene_id % 7 <> 6").select("scene_id", "row", "col", F.col("pred").alias("z"))


@query(f"WITH {_COV} SELECT s AS scene_id, nr AS n_reference, no AS n_overlap, round(no / nr, 6) AS overlap, CASE WHEN no = 0 THEN 'GRID_MISMATCH' ELSE 'OK' END AS status_code FROM cv")
def d35_coverage(spark, d):
    return reports.coverage(_ok(spark, d), _candidate(spark, d))


@query(f"""WITH {_INNER}, h AS (SELECT s, r, c FROM tw WHERE c < 30 AND s % 7 <> 6), cv AS (SELECT s, count(*) AS nr, count(*) FILTER (c < 30 AND s % 7 <> 6) AS no FROM tw GROUP BY s),
er AS (SELECT s, {ERRORS.replace('count(*) AS n, ', '')} FROM tw JOIN h USING (s, r, c) GROUP BY s), sl AS (SELECT s, {_SL} AS d FROM g JOIN h USING (s, r, c) WHERE c < 29),
se AS (SELECT s, round(avg(abs(d)), 6) AS slope_mae_deg, round(sqrt(avg(d * d)), 6) AS slope_rmse_deg, round(avg(d), 6) AS slope_bias_deg FROM sl GROUP BY s)
SELECT s AS scene_id, nr AS n_reference, no AS n_overlap, round(no / nr, 6) AS overlap, CASE WHEN no = 0 THEN 'GRID_MISMATCH' ELSE 'OK' END AS status_code, mae, rmse, bias, r, neg_frac, slope_mae_deg, slope_rmse_deg, slope_bias_deg FROM cv LEFT JOIN er USING (s) LEFT JOIN se USING (s)""")
def d36_eval_absolute(spark, d):
    truth = two(spark, d).select("scene_id", "row", "col", F.col("truth").alias("z"))
    return reports.eval_absolute(_candidate(spark, d), truth, 0.5)


@query(f"WITH {EV} SELECT cls, count(*) AS n, round(sqrt(avg((z - truth) ** 2)), 6) AS rmse, round(avg(abs(z - truth)), 6) AS mae, round(CASE WHEN stddev_pop(z) > 1e-9 AND stddev_pop(truth) > 1e-9 THEN corr(z, truth) END, 6) AS corr FROM ok GROUP BY cls")
def d37_validation_metrics(spark, d):
    return reports.validation_metrics(_pairs(spark, d), "cls")


@query(f"WITH {TW} SELECT {RC}, round(pred - truth, 6) AS error FROM tw WHERE c < 30 AND s % 7 <> 6")
def d38_error_map(spark, d):
    return reports.error_map(_candidate(spark, d), two(spark, d).select("scene_id", "row", "col", F.col("truth").alias("z")))


@query(f"""WITH {TW}, j AS (SELECT a.s, abs((a.pred - b.pred) - (a.truth - b.truth)) AS d FROM tw a JOIN tw b ON a.s = b.s AND ((a.r = b.r + 1 AND a.c = b.c) OR (a.c = b.c + 1 AND a.r = b.r)))
SELECT s AS scene_id, round(avg(d), 6) AS gradient_loss, count(*) AS n FROM j GROUP BY s""")
def d44_gradient_loss(spark, d):
    return reports.gradient_loss(two(spark, d))


@query(f"WITH {_INNER} SELECT s AS scene_id, round(avg(abs(atan(sqrt((gxp / 0.33) ** 2 + (gyp / 0.33) ** 2 + 1e-8)) - atan(sqrt((gxt / 0.33) ** 2 + (gyt / 0.33) ** 2 + 1e-8)))), 6) AS slope_loss FROM g GROUP BY s")
def d44_slope_angle_loss(spark, d):
    return reports.slope_angle_loss(two(spark, d), 0.33)


@query(f"WITH {soft('label', 6)} SELECT vec_id // 50 AS scene_id, round(avg(-ln(p[label + 1])), 6) AS ce, count(*) AS n FROM pr WHERE label < 6 GROUP BY 1")
def d44_semantic_ce(spark, d):
    e = fx.table(spark, d, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 6), lambda v: v.cast("double") * 20)
    target = F.when(F.col("label") < 6, F.col("label")).otherwise(255)
    return reports.semantic_ce(e.select(F.floor(F.col("vec_id") / 50).alias("scene_id"), logits.alias("logits"), target.alias("target")))


@query(f"""WITH {EV}, t AS (SELECT s, r // 8 AS tr, c // 8 AS tc, count(*) AS n, count(*) FILTER (NOT isnan(z) AND z <> -9999) AS nv, min(truth / 90) FILTER (NOT isnan(z) AND z <> -9999) AS lo, max(truth / 90) FILTER (NOT isnan(z) AND z <> -9999) AS hi FROM ev GROUP BY ALL)
SELECT s AS scene_id, tr, tc, CASE WHEN n <> 64 THEN 'SHAPE' WHEN nv = 0 THEN 'NO_VALID_DATA' WHEN lo < -1e-6 OR hi > 1 + 1e-6 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS reason FROM t""")
def d46_verify_tiles(spark, d):
    px = fx.pixels(spark, d)
    return reports.verify_tiles(px.withColumn("dn", F.when(F.isnan("z") | (F.col("z") == fx.NODATA), float("nan")).otherwise(F.col("truth") / 90)), 8)


@query(f"WITH {EV} SELECT s AS scene_id, cls, count(*) FILTER (NOT isnan(z) AND z <> -9999) AS n_valid, count(*) FILTER (isnan(z) OR z = -9999) AS n_invalid, round(coalesce(avg(z) FILTER (NOT isnan(z) AND z <> -9999), 'nan'::DOUBLE), 6) AS mean FROM ev GROUP BY ALL")
def d47_visual_stats(spark, d):
    ok = ~F.isnan("z") & (F.col("z") != fx.NODATA)
    mean = F.coalesce(F.avg(F.when(ok, F.col("z"))), F.lit(float("nan")))
    return fx.pixels(spark, d).groupBy("scene_id", "cls").agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"), mean.alias("mean"))


@query(f"WITH {EV}, st AS (SELECT s, avg(z) AS m, stddev_pop(z) AS sd, min(z) AS lo, max(z) AS hi FROM ok GROUP BY s) SELECT s AS scene_id, round(m, 6) AS shift, round(sd, 6) AS scale, round((lo - m) / sd, 6) AS norm_min, round((hi - m) / sd, 6) AS norm_max FROM st")
def d48_normalisation_report(spark, d):
    norm, params = pixels.normalize_dem(_ok(spark, d), "zscore", fx.NODATA)
    return norm.groupBy("scene_id").agg(F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max")).join(params, "scene_id").select("scene_id", "shift", "scale", "norm_min", "norm_max")


@query(f"""WITH {_W}, w AS (SELECT s, ri * 4 + ci AS w, r, c, truth + (ri * 4 + ci) * c / 10.0 AS z FROM ev, wr, wc WHERE r BETWEEN ro AND ro + 15 AND c BETWEEN co AND co + 15)
SELECT a.s AS scene_id, round(avg(abs(a.z - b.z)), 6) AS window_gap, count(*) AS n_pairs FROM w a JOIN w b ON a.s = b.s AND a.r = b.r AND a.c = b.c AND a.w < b.w GROUP BY a.s""")
def d50_window_consistency(spark, d):
    t = tiling.tile_pixels(_smooth(spark, d), fx.scenes(spark, d), 16, 8)
    window = F.col("ri") * 4 + F.col("ci")
    return reports.window_consistency(t.select("scene_id", window.alias("window"), "row", "col", (F.col("z") + window * F.col("col") / 10.0).alias("z")))


# --- A, C, H, I, J, K ----------------------------------------------------------------------------------------------

_FILES = f"{_STEMS}, fi AS (SELECT DISTINCT stem, CASE o_custkey % 3 WHEN 0 THEN 'rgb' WHEN 1 THEN 'agl' ELSE 'cls' END AS kind FROM st JOIN orders USING (o_orderkey))"


def _files(spark, d) -> DataFrame:
    k = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "rgb").when(F.col("o_custkey") % 3 == 1, "agl").otherwise("cls").alias("kind"))
    return _stems(spark, d).join(k, "o_orderkey").select("stem", "kind").distinct()


@query(f"WITH {_FILES}, t AS (SELECT stem, bool_or(kind = 'rgb') AS a, bool_or(kind = 'agl') AS b, bool_or(kind = 'cls') AS c FROM fi GROUP BY stem) SELECT stem, a AS has_rgb, b AS has_agl, c AS has_cls, a AND b AND c AS whole, CASE WHEN a AND NOT b AND NOT c THEN 'RGB_WITHOUT_TRUTH' WHEN NOT a THEN 'TRUTH_WITHOUT_RGB' END AS problem FROM t")
def a05_discover_triples(spark, d):
    return listings.discover_triples(_files(spark, d))


@query(f"WITH {_FILES} SELECT stem, kind FROM (SELECT DISTINCT stem FROM st), (VALUES ('rgb'), ('agl'), ('cls')) k(kind) EXCEPT SELECT stem, kind FROM fi")
def a08_check_triples(spark, d):
    return listings.check_triples(_stems(spark, d).select("stem").distinct(), _files(spark, d))


_CACHE = "ca AS (SELECT ps_key AS sample, layout, layout || '/' || ps_key AS path FROM (SELECT l_partkey AS ps_key, CASE WHEN l_linenumber % 2 = 0 THEN 'flat' ELSE 'namespaced' END AS layout FROM lineitem WHERE l_linenumber < 3) GROUP BY ALL)"


def _cache(spark, d) -> DataFrame:
    li = fx.table(spark, d, "lineitem").where("l_linenumber < 3")
    layout = F.when(F.col("l_linenumber") % 2 == 0, "flat").otherwise("namespaced")
    return li.select(F.col("l_partkey").alias("sample"), layout.alias("layout")).distinct().withColumn("path", F.concat_ws("/", "layout", F.col("sample").cast("string")))


def _samples(spark, d) -> DataFrame:
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("sample"))


@query(f"WITH {_CACHE} SELECT p_partkey AS sample, layout, path FROM part LEFT JOIN (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY sample ORDER BY layout = 'flat', path) = 1) ON sample = p_partkey")
def a09_cache_lookup(spark, d):
    return listings.cache_lookup(_samples(spark, d), _cache(spark, d))


@query(f"WITH {_CACHE} SELECT p_partkey AS sample FROM part WHERE p_partkey NOT IN (SELECT sample FROM ca)")
def a10_cache_worklist(spark, d):
    return listings.cache_worklist(_samples(spark, d), _cache(spark, d).select("sample").distinct())


@query(f"WITH {EV} SELECT s AS scene_id, max(r) + 1 AS height, max(c) + 1 AS width, round(min(truth), 6) AS lo, round(max(truth), 6) AS hi, count(*) AS n FROM ev GROUP BY s")
def a10_cache_manifest(spark, d):
    return listings.cache_manifest(_smooth(spark, d))


@query(f"WITH {EV} SELECT s AS scene_id, 'GRID_MISMATCH' AS status_code, '24x40 is not 25x40' AS detail FROM (SELECT DISTINCT s FROM ev) WHERE s % 3 = 0")
def a11_depth_cache_sync(spark, d):
    """Every third scene was cached without its last row."""
    cached = listings.cache_manifest(_smooth(spark, d).where("scene_id % 3 <> 0 or row < 24"))
    return listings.depth_cache_sync(fx.scenes(spark, d), cached)


_ART = f"sc AS (SELECT DISTINCT event_id // 1000 AS s FROM events), ar AS (SELECT user_id % (SELECT max(s) + 3 FROM sc) AS s, CASE event_type WHEN 'click' THEN 'dsm.tif' WHEN 'view' THEN 'labels.png' WHEN 'error' THEN 'probs.npy' WHEN 'signup' THEN 'mesh.glb' ELSE 'notes.txt' END AS name FROM events WHERE event_id % 97 = 0)"
KNOWN = {"dsm.tif": "terrain", "mesh.glb": "terrain", "labels.png": "semantics", "probs.npy": "semantics"}


def _catalog(spark, d) -> DataFrame:
    names = F.create_map(*(F.lit(x) for x in ("click", "dsm.tif", "view", "labels.png", "error", "probs.npy", "signup", "mesh.glb", "purchase", "notes.txt")))
    scenes = fx.scenes(spark, d)
    n = scenes.agg((F.max("scene_id") + 3).alias("n"))
    e = fx.table(spark, d, "events").where("event_id % 97 = 0").crossJoin(F.broadcast(n))  # one row
    return listings.result_catalog(scenes, e.select((F.col("user_id") % F.col("n")).alias("scene_id"), names[F.col("event_type")].alias("name")), KNOWN)


_CATSQL = f"{_ART}, ct AS (SELECT sc.s AS scene_id, count(DISTINCT name) FILTER (name <> 'notes.txt') AS n_artifacts, coalesce(bool_or(name IN ('labels.png', 'probs.npy')), false) AS can_semantics, coalesce(bool_or(name IN ('dsm.tif', 'mesh.glb')), false) AS can_terrain FROM sc LEFT JOIN ar USING (s) GROUP BY sc.s)"


@query(f"WITH {_CATSQL} SELECT * FROM ct")
def a12_result_catalog(spark, d):
    return _catalog(spark, d)


@query("""WITH r AS (SELECT o_orderkey AS scene_id, o_custkey % 7 AS owner, o_orderdate AS created FROM orders WHERE o_custkey % 7 = 3)
SELECT scene_id, owner, created, scene_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_results, row_number() OVER (ORDER BY created DESC, scene_id) AS place FROM r""")
def a13_scene_list(spark, d):
    scenes = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), (F.col("o_custkey") % 7).alias("owner"), F.col("o_orderdate").alias("created"))
    results = fx.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_id"))
    return listings.scene_list(scenes, results, 3)


@query("SELECT s_suppkey AS scene_id, (s_suppkey * 7 % 300)::INT AS height, (s_suppkey * 11 % 300)::INT AS width, CASE WHEN s_suppkey % 3 = 0 THEN 'relative' ELSE 'absolute' END AS processing_path, CASE WHEN s_suppkey * 7 % 300 < 64 OR s_suppkey * 11 % 300 < 64 THEN 'IMAGE_TOO_SMALL' ELSE 'OK' END AS status_code FROM supplier")
def a18_inspect_scene(spark, d):
    k = F.col("s_suppkey")
    return listings.inspect_scene(fx.table(spark, d, "supplier").select(k.alias("scene_id"), (k * 7 % 300).cast("int").alias("height"), (k * 11 % 300).cast("int").alias("width"), F.when(k % 3 != 0, "EPSG:4326").alias("crs")))


@query(f"""WITH {EV}, {JOBS}, lj AS (SELECT scene_id, arg_max(job_id, (ts, event_id)) AS job_id, arg_max(status, (ts, event_id)) AS status FROM j GROUP BY scene_id), {_CATSQL}, hs AS (SELECT s, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM ok GROUP BY s)
SELECT ct.scene_id, CASE WHEN ct.scene_id % 5 <> 4 THEN 'EPSG:32632' END AS crs, job_id, status, lo, hi, n_artifacts, can_semantics, can_terrain FROM ct LEFT JOIN lj USING (scene_id) LEFT JOIN hs ON hs.s = ct.scene_id""")
def a19_scene_results(spark, d):
    stats = reports.array_stats(_ok(spark, d), "scene_id").select("scene_id", "lo", "hi")
    return listings.scene_results(fx.scenes(spark, d), jobs.active_job(fx.job_events(spark, d)), stats, _catalog(spark, d))


@query(f"WITH {_STEMS} SELECT stem, CASE WHEN sum(o_orderkey) % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM st WHERE stem NOT LIKE 'broken%' GROUP BY stem")
def c11_apply_splits(spark, d):
    stems = _stems(spark, d)
    known = stems.where("stem not like 'broken%'").groupBy("stem").agg(F.when(F.sum("o_orderkey") % 2 == 0, "train").otherwise("val").alias("split"))
    return listings.apply_splits(stems.select("stem").distinct(), known)[0]


@query(f"WITH {_STEMS} SELECT DISTINCT stem FROM st WHERE stem LIKE 'broken%'")
def c11_missing_stems(spark, d):
    stems = _stems(spark, d)
    return listings.apply_splits(stems.select("stem").distinct(), stems.where("stem not like 'broken%'").select("stem", F.lit("train").alias("split")).distinct())[1]


@query(f"WITH {LI}, b AS (SELECT * FROM li WHERE split = 'A' AND tile IN (SELECT tile FROM li WHERE split = 'R' AND city = 'F')) SELECT tile, {ERRORS} FROM b GROUP BY tile")
def c12_tile_aligned_baseline(spark, d):
    p = fx.metric_pairs(spark, d)
    tiles = p.where("split = 'R' and city = 'F'").select("tile").distinct()
    return metrics.pooled_metrics(p.where("split = 'A'").join(tiles, "tile", "left_semi"), "tile")


@query("SELECT source, 'STATS_MISSING' AS status_code FROM (SELECT DISTINCT source FROM (SELECT n_name AS source FROM supplier JOIN nation ON n_nationkey = s_nationkey)) WHERE source NOT IN (SELECT n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 50 = 0)")
def c13_stats_gate(spark, d):
    nation = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("source"))
    mixed = fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).join(nation, "k")
    stats = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 50 == 0).alias("verified")).join(nation, "k")
    return listings.stats_gate(mixed, stats)


_REF = "fl AS (SELECT o_custkey AS scene_id, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Reference.TIF' ELSE 'my_reference.tif' END WHEN 1 THEN 'a' || o_orderkey || '-truth.tif' WHEN 2 THEN 'b' || o_orderkey || '_gt.tiff' WHEN 3 THEN 'vgt' || o_orderkey || '.tif' ELSE 'truth.png' END AS name, o_orderkey % 4 = 0 AS own FROM orders)"
_FIT = "NOT own AND (lower(name) LIKE '%.tif' OR lower(name) LIKE '%.tiff')"
_MARK = f"{_FIT} AND (contains(lower(name), 'reference') OR contains(lower(name), 'truth') OR contains(lower(name), '_gt'))"


@query(f"""WITH {_REF}, t AS (SELECT scene_id, min(name) FILTER ({_FIT} AND lower(name) IN ('reference.tif', 'reference_dem.tif', 'ref_dem.tif')) AS ex, count(*) FILTER ({_MARK}) AS n, min(name) FILTER ({_MARK}) AS mk FROM fl GROUP BY scene_id)
SELECT scene_id, coalesce(ex, CASE WHEN n = 1 THEN mk END) AS reference, ex IS NULL AND n > 1 AS ambiguous FROM t""")
def c14_pick_reference(spark, d):
    """Every fourth order is its scene's own input."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    exact = F.when(k % 3 == 0, "Reference.TIF").otherwise("my_reference.tif")
    name = F.when(k % 5 == 0, exact).when(k % 5 == 1, F.concat(F.lit("a"), s, F.lit("-truth.tif"))).when(k % 5 == 2, F.concat(F.lit("b"), s, F.lit("_gt.tiff"))).when(k % 5 == 3, F.concat(F.lit("vgt"), s, F.lit(".tif"))).otherwise("truth.png")
    return listings.pick_reference(fx.table(spark, d, "orders").select(F.col("o_custkey").alias("scene_id"), name.alias("name"), (k % 4 == 0).alias("is_input")))


_UV = "uv AS (SELECT o_orderkey AS point_id, o_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (o_custkey % 120 - 10) / 100.0::DOUBLE AS u, (o_orderkey % 90) / 89.0::DOUBLE AS v FROM orders WHERE o_orderstatus = 'P')"
_BI = "SELECT {q}.point_id, sum((CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * truth) AS z FROM {q}, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), ev WHERE ev.s = {q}.s AND ev.r = least(floor(y) + i, 24) AND ev.c = least(floor(x) + j, 39) GROUP BY {q}.point_id"


def _uv(spark, d) -> DataFrame:
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    o = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").crossJoin(F.broadcast(n))  # one row
    return o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % F.col("n_scenes")).alias("scene_id"), ((F.col("o_custkey") % 120 - 10) / 100.0).alias("u"), (F.col("o_orderkey") % 90 / 89.0).alias("v"))


@query(f"WITH {EV}, {_UV}, xy AS (SELECT point_id, s, least(greatest(u, 0), 1) * 39 AS x, least(greatest(v, 0), 1) * 24 AS y FROM uv) SELECT point_id, round(z, 6) AS z FROM ({_BI.format(q='xy')})")
def c16_sample_bilinear(spark, d):
    return sampling.sample_bilinear(_uv(spark, d), _smooth(spark, d), fx.HEIGHT, fx.WIDTH)


@query(f"""WITH {EV}, {_UV}, mc AS (SELECT s, avg(CASE WHEN truth <= 60 THEN truth / 100 END) AS m FROM ev GROUP BY s), q AS (SELECT point_id, s, least(greatest(floor(u * 39 + 0.5), 0), 39) AS c, least(greatest(floor(v * 24 + 0.5), 0), 24) AS r FROM uv)
SELECT point_id, cls, round(coalesce(CASE WHEN truth <= 60 THEN truth / 100 END, m), 6) AS conf FROM q JOIN ev USING (s, r, c) JOIN mc USING (s)""")
def c17_sample_class(spark, d):
    px = fx.pixels(spark, d).withColumn("conf", F.when(F.col("truth") <= 60, F.col("truth") / 100))
    return sampling.sample_class(_uv(spark, d), px, fx.HEIGHT, fx.WIDTH)


_FOUR = ", ".join(f"q{k} AS (SELECT point_id, s, least(greatest(u + {a} / 39.0::DOUBLE, 0), 1) * 39 AS x, least(greatest(v + {b} / 24.0::DOUBLE, 0), 1) * 24 AS y FROM uv), b{k} AS ({_BI.format(q=f'q{k}')})" for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)]))


@query(f"""WITH {EV}, {_UV}, {_FOUR}, g AS (SELECT b0.point_id, b0.z - b1.z AS gx, b2.z - b3.z AS gy FROM b0 JOIN b1 USING (point_id) JOIN b2 USING (point_id) JOIN b3 USING (point_id))
SELECT point_id, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) AS slope, round(-gx / sqrt(gx * gx + gy * gy + 1), 4) AS nx, round(-gy / sqrt(gx * gx + gy * gy + 1), 4) AS ny, round(1 / sqrt(gx * gx + gy * gy + 1), 4) AS nz FROM g""", 4)
def c18_sample_slope(spark, d):
    return sampling.sample_slope(_uv(spark, d), _smooth(spark, d), fx.HEIGHT, fx.WIDTH, 0.5)


@query(f"""WITH {EV}, q AS (SELECT o_orderkey AS pair_id, o_orderkey % (SELECT max(s) + 1 FROM ev) AS s, (o_custkey % 25)::INT AS r1, (o_orderkey % 40)::INT AS c1, (o_custkey * 3 % 25)::INT AS r2, (o_orderkey * 7 % 40)::INT AS c2, CASE WHEN o_custkey % 3 <> 0 THEN 0.5::DOUBLE END AS gsd FROM orders WHERE o_orderstatus = 'P'),
m AS (SELECT q.*, CASE WHEN NOT isnan(a.z) THEN a.z END AS z1, CASE WHEN NOT isnan(b.z) THEN b.z END AS z2 FROM q LEFT JOIN ev a ON a.s = q.s AND a.r = r1 AND a.c = c1 LEFT JOIN ev b ON b.s = q.s AND b.r = r2 AND b.c = c2),
t AS (SELECT *, CASE WHEN r1 = r2 AND c1 = c2 THEN 'EQUAL_POINTS' WHEN z2 - z1 IS NULL THEN 'NO_DATA' ELSE 'OK' END AS k, sqrt((r2 - r1) ** 2 + (c2 - c1) ** 2) * coalesce(gsd, 1) AS dist FROM m)
SELECT pair_id, k AS status_code, round(CASE WHEN k = 'OK' THEN z2 - z1 END, 6) AS rise, round(CASE WHEN k = 'OK' THEN dist END, 6) AS distance, round(CASE WHEN k = 'OK' AND gsd IS NOT NULL THEN degrees(atan2(abs(z2 - z1), dist)) END, 6) AS slope_deg FROM t""")
def c19_measure(spark, d):
    n = fx.pixels(spark, d).agg((F.max("scene_id") + 1).alias("n_scenes"))
    o = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").crossJoin(F.broadcast(n))  # one row
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = o.select(k.alias("pair_id"), (k % F.col("n_scenes")).alias("scene_id"), (c % 25).cast("int").alias("r1"), (k % 40).cast("int").alias("c1"), (c * 3 % 25).cast("int").alias("r2"), (k * 7 % 40).cast("int").alias("c2"), F.when(c % 3 != 0, 0.5).alias("gsd"))
    return sampling.measure(pairs, fx.pixels(spark, d))


@query()
def h02_tile_split(spark, d):
    return listings.tile_split(_stems(spark, d).select("stem").distinct(), (0.7, 0.15))


@query("""WITH a AS (SELECT c_custkey AS sample, 'customer' AS source, 3.0::DOUBLE AS w FROM customer UNION ALL SELECT s_suppkey, 'supplier', 1.0::DOUBLE FROM supplier) SELECT sample, source, round(w / count(*) OVER (PARTITION BY source), 9) AS weight, count(*) OVER (PARTITION BY sample) > 1 AS duplicate FROM a""", 9)
def h04_mix_sources(spark, d):
    sources = {"customer": fx.table(spark, d, "customer").select(F.col("c_custkey").alias("sample")), "supplier": fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"))}
    return listings.mix_sources(sources, {"customer": 3.0, "supplier": 1.0})


@query()
def h05_random_crop(spark, d):
    return listings.random_crop(fx.pixels(spark, d), fx.HEIGHT, fx.WIDTH, 16)


@query(f"WITH {EV} SELECT DISTINCT s AS scene_id, r AS \"row\", c AS col FROM ev WHERE cls = 6 OR truth > 80")
def i05_mask_union(spark, d):
    px = fx.pixels(spark, d).select("scene_id", "row", "col", "cls", "truth")
    return px.where("cls = 6").unionByName(px.where("truth > 80")).select("scene_id", "row", "col").distinct()


@query(f"WITH {_FILES} SELECT stem FROM fi WHERE kind = 'rgb' INTERSECT SELECT stem FROM fi WHERE kind = 'agl'")
def i06_stems_in_both(spark, d):
    f = _files(spark, d)
    return f.where("kind = 'rgb'").select("stem").intersect(f.where("kind = 'agl'").select("stem"))


@query(f"WITH {_FILES} SELECT stem FROM fi WHERE kind = 'rgb' EXCEPT SELECT stem FROM fi WHERE kind = 'cls'")
def i07_stems_without(spark, d):
    f = _files(spark, d)
    return f.where("kind = 'rgb'").select("stem").subtract(f.where("kind = 'cls'").select("stem"))


@query(f"WITH {EV} SELECT DISTINCT a.s AS scene_id, a.r AS \"row\", a.c AS col FROM ev a JOIN ev b ON a.s = b.s AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 WHERE b.cls = 6 AND a.cls <> 6")
def i08_rings(spark, d):
    """Pixels within two of a building that are none themselves."""
    from gridspark.operators import focal

    mask = fx.pixels(spark, d).select("scene_id", "row", "col", (F.col("cls") == 6).cast("int").alias("m"))
    return joins.missing_from(focal.dilate(mask, 2).where("m = 1").select("scene_id", "row", "col"), mask.where("m = 1"), ["scene_id", "row", "col"])


@query(f"""WITH {JOBS}, c AS (SELECT job_id, min(ts) AS created, arg_max(status, (ts, event_id)) AS status FROM j GROUP BY job_id), n AS (SELECT max(ts) AS now FROM j), a AS (SELECT c.*, date_diff('second', created, now) > 200 * 3600 AS old FROM c, n),
o AS (SELECT job_id FROM a WHERE NOT old AND status IN ('completed', 'failed') ORDER BY created, job_id LIMIT (SELECT greatest(count(*) - 20, 0) FROM a WHERE NOT old))
SELECT job_id, 'expired' AS why FROM a WHERE old UNION ALL SELECT job_id, 'overflow' FROM o""")
def j04_job_retention(spark, d):
    e = fx.job_events(spark, d)
    state = e.groupBy("job_id").agg(F.min("ts").alias("created"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    now = e.agg(F.max("ts")).first()[0]
    return listings.job_retention(state, F.lit(now).cast("timestamp_ntz"), ttl_hours=200, keep=20)


@query(f"""WITH {JOBS}, st AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS seen FROM j GROUP BY job_id), n AS (SELECT max(ts) AS now FROM j), k AS (SELECT job_id, min(ts) FILTER (status IN ('completed', 'failed')) AS ended FROM j GROUP BY job_id)
SELECT job_id, 'JOB_INTERRUPTED' AS error FROM st JOIN k USING (job_id), n WHERE ended IS NULL AND date_diff('second', seen, now) > CASE WHEN status = 'queued' THEN 60 ELSE 3600 END""")
def j03_stale_jobs(spark, d):
    e = fx.job_events(spark, d)
    return jobs.stale_jobs(jobs.job_state(e), e, str(e.agg(F.max("ts")).first()[0]))


@query(f"""WITH {EV}, cv AS (SELECT s, count(*) FILTER (c < 30 AND s % 7 <> 6) AS no FROM ok GROUP BY s), sc AS (SELECT DISTINCT s FROM ev)
SELECT s AS scene_id, 'coverage' AS op, 'GRID_MISMATCH' AS status_code FROM cv WHERE no = 0 UNION ALL SELECT s, 'inspect', 'IMAGE_TOO_SMALL' FROM sc UNION ALL SELECT s, 'mosaic', 'CRS_MISMATCH' FROM sc WHERE s % 5 = 4""")
def k08_quality(spark, d):
    scenes = fx.scenes(spark, d)
    return listings.quality({"coverage": reports.coverage(_ok(spark, d), _candidate(spark, d)), "inspect": listings.inspect_scene(scenes), "mosaic": tiling.mosaic_problems(scenes)})


@query("SELECT s_suppkey AS object_id, json_object('type', 'Feature', 'properties', json_object('id', s_suppkey, 'confidence', round((s_suppkey % 97) / 97.0::DOUBLE, 3), 'label', s_suppkey % 4), 'geometry', json_object('type', 'Polygon', 'coordinates', [[[x, y], [x + 0.5, y], [x + 0.5, y + 0.25], [x, y]]]))::VARCHAR AS feature FROM (SELECT *, (s_suppkey % 360)::DOUBLE AS x, (s_suppkey % 50)::DOUBLE AS y FROM supplier)")
def a16_to_geojson(spark, d):
    k = F.col("s_suppkey")
    x, y = (k % 360).cast("double"), (k % 50).cast("double")
    ring = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.25))))
    return listings.to_geojson(fx.table(spark, d, "supplier").select(k.alias("object_id"), ring.alias("ring"), (k % 97 / 97.0).alias("conf"), (k % 4).alias("label")))


@query(f"""WITH {LI}, m AS (SELECT split, count(*) AS n, avg(abs(pred - truth)) AS mae FROM li GROUP BY split) SELECT 0 AS n, '| split | n | mae |' AS line UNION ALL SELECT 1, '|-|-|-|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY split), '| ' || split || ' | ' || n || ' | ' || printf('%.3f', mae) || ' |' FROM m""")
def a15_markdown_report(spark, d):
    return listings.markdown_table(metrics.pooled_metrics(fx.metric_pairs(spark, d), "split").select("split", "n", "mae"))
