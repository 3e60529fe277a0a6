"""Reports built from errors and statistics: by class and city, slopes and gradients, acceptance, coverage, datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite
from gridspark.operators import focal, metrics, pixels
from gridspark.operators.quantiles import percentiles
from gridspark.plans.lineage import cut

KEYS = ["scene_id", "row", "col"]


def array_stats(px: DataFrame, *keys: str) -> DataFrame:
    """Range, mean, exact median and relief of finite values."""
    v = F.when(finite(F.col("z")), F.col("z"))
    return px.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), (F.max(v) - F.min(v)).alias("relief"), F.count_if(v < 0).alias("n_negative"))


def by_project_class(pairs: DataFrame, legend: DataFrame, ignore: int = 255) -> DataFrame:
    """Pooled errors of each project class; unlabelled pixels are left out."""
    mapped, _ = pixels.map_classes(pairs, legend, ignore)
    return metrics.pooled_metrics(mapped.where(F.col("project_cls") != ignore), "project_cls")


def by_city(pairs: DataFrame) -> DataFrame:
    """Errors of each city pooled over pixels, and as the mean over its tiles: both are in use, and they differ."""
    pooled = metrics.pooled_metrics(pairs, "city").select("city", F.col("mae").alias("pooled_mae"), F.col("rmse").alias("pooled_rmse"))
    tiles = metrics.mean_std_over_tiles(metrics.pooled_metrics(pairs, "tile", "city"), ["mae", "rmse"], "city")
    return pooled.join(tiles.select("city", "mae_mean", "rmse_mean", "n_tiles"), "city")


def tile_metric_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of each metric of long rows(key, value); values that are not finite are skipped."""
    return rows.groupBy(*keys, "key").agg(F.avg(F.when(finite(F.col("value")), F.col("value"))).alias("mean"), F.count_if(finite(F.col("value"))).alias("n"))


def scene_type_labelled(px: DataFrame, legend: DataFrame, building: int = 0, vegetation: int = 1, ignore: int = 255) -> DataFrame:
    """Type of each scene from the shares of project classes among labelled pixels, and relief (p95 - p50; 0 for ten valid pixels or fewer)."""
    mapped, _ = pixels.map_classes(px, legend, ignore)
    cls = F.when(F.col("project_cls") != ignore, F.col("project_cls"))
    v = F.when(finite(F.col("z")), F.col("z"))
    s = mapped.groupBy("scene_id").agg(F.avg((cls == building).cast("double")).alias("b"), F.avg((cls == vegetation).cast("double")).alias("v"), F.count(v).alias("n"))
    s = s.join(percentiles(px.where(finite(F.col("z"))), ["scene_id"], "z", [0.5, 0.95]).drop("n"), "scene_id", "left")
    relief = F.when(F.col("n") > 10, F.col("p")[1] - F.col("p")[0]).otherwise(0.0)
    kind = F.when(F.col("b").isNull(), "flat").when(F.col("b") >= 0.15, "urban").when(F.col("v") >= 0.5, "forest").when(relief >= 15, "hilly-high-relief").when(F.col("b") >= 0.02, "sparse-suburban").otherwise("flat")
    return s.select("scene_id", F.col("b").alias("building_share"), F.col("v").alias("vegetation_share"), relief.alias("relief"), kind.alias("scene_type"))


def by_scene_type(per_tile: DataFrame, types: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each metric over the tiles of each scene type."""
    joined = per_tile.join(types.select("scene_id", "scene_type"), "scene_id")
    return joined.groupBy("scene_type").agg(*(F.avg(F.when(finite(F.col(m)), F.col(m))).alias(f"{m}_mean") for m in names), F.count("*").alias("n_tiles"))


def _both_gradients(pairs: DataFrame) -> DataFrame:
    """Gradients of ``pred`` and ``truth`` beside each other, from one pass over rows and one over columns."""
    out = pairs
    for name, along in (("gy", "row"), ("gx", "col")):
        across = "col" if along == "row" else "row"
        w = Window.partitionBy("scene_id", across).orderBy(along)
        edge = F.lag(F.lit(1)).over(w).isNull() | F.lead(F.lit(1)).over(w).isNull()
        out = out.withColumns({f"{name}_{c}": (F.lead(c).over(w) - F.lag(c).over(w)) / 2 for c in ("pred", "truth")} | {f"edge_{name}": edge})
    return out.where("not edge_gy and not edge_gx").drop("edge_gy", "edge_gx")


def _slope(side: str, gsd: float) -> F.Column:
    return F.degrees(F.atan(F.hypot(F.col(f"gy_{side}") / gsd, F.col(f"gx_{side}") / gsd)))


def slope_error(pairs: DataFrame, gsd: float | None) -> DataFrame | None:
    """Errors of slope in degrees by scene, border left out; nothing without a ground distance."""
    if not gsd or gsd <= 0:
        return None
    d = _both_gradients(pairs).withColumn("d", _slope("pred", gsd) - _slope("truth", gsd)).where(finite(F.col("d")))
    return d.groupBy("scene_id").agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("slope_mae_deg"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("slope_rmse_deg"), F.avg("d").alias("slope_bias_deg"))


def gradient_error(pairs: DataFrame) -> DataFrame:
    """Mean difference of the gradients by scene, over both axes, border left out."""
    d = (F.abs(F.col("gy_pred") - F.col("gy_truth")) + F.abs(F.col("gx_pred") - F.col("gx_truth"))) / 2
    return _both_gradients(pairs).withColumn("d", d).where(finite(F.col("d"))).groupBy("scene_id").agg(F.count("*").alias("n"), F.avg("d").alias("grad_mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("grad_rmse"))


def boundary_metrics(pairs: DataFrame, building: int, other: int, band: int = 2) -> DataFrame:
    """Errors within each boundary band: any class, building, building to another class."""
    marked = focal.boundary_bands(pairs, building, other, band)
    bands = F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("any_band", "building_band", "building_other"))), lambda x: x.isNotNull())
    return metrics.pooled_metrics(marked.withColumn("band", F.explode(bands)), "band")


def jump_ratio(pairs: DataFrame, least: float = 2.0) -> DataFrame:
    """Predicted over true jumps between neighbours that are both in ``band`` where the truth jumps by more than ``least``."""
    parts = []
    for along, across in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("scene_id", across).orderBy(along)
        jump = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
        parts.append(pairs.select("scene_id", jump("pred").alias("p"), jump("truth").alias("t"), (F.col("band") & F.lag("band").over(w)).alias("both")))
    chosen = parts[0].unionByName(parts[1]).where(F.col("both") & (F.col("t") > least))
    return chosen.groupBy("scene_id").agg(F.count("*").alias("n_pairs"), (F.sum("p") / F.sum("t")).alias("jump_ratio"))


def before_after(pairs: DataFrame, eps: float = 1e-4) -> DataFrame:
    """What a refinement did to each scene of ``pairs(raw, refined)``: errors, changed share, and how much of the steepest edges (over the 95th percentile) is left."""
    g = focal.gradient(pairs.withColumn("z", F.col("raw"))).withColumn("g_raw", F.hypot("gy", "gx")).drop("gy", "gx")
    g = focal.gradient(g.withColumn("z", F.col("refined"))).withColumn("g_ref", F.hypot("gy", "gx"))
    d = F.abs(F.col("refined") - F.col("raw"))
    g = cut(g)
    limit = percentiles(g, ["scene_id"], "g_raw", [0.95]).select("scene_id", F.col("p")[0].alias("limit"))
    steep = F.col("g_raw") > F.col("limit")
    s = g.withColumn("d", d).join(limit, "scene_id").groupBy("scene_id").agg(
        F.count("*").alias("n"), (F.avg((F.col("d") > eps).cast("double")) * 100).alias("changed_percent"), F.avg("d").alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.max("d").alias("max_ae"), F.avg(F.when(steep, F.col("g_ref"))).alias("e_ref"), F.avg(F.when(steep, F.col("g_raw"))).alias("e_raw"),
    )
    s = s.join(percentiles(g.withColumn("d", d), ["scene_id"], "d", [0.5, 0.95, 0.99]).drop("n"), "scene_id", "left")
    return s.select("scene_id", "n", "changed_percent", "mae", "rmse", "max_ae", F.col("p")[0].alias("medae"), F.col("p")[1].alias("p95_ae"), F.col("p")[2].alias("p99_ae"), F.coalesce(F.col("e_ref") / F.greatest("e_raw", F.lit(1e-6)), F.lit(1.0)).alias("edge_preservation"))


def calibration_report(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean, median and deviation of raw and refined heights, their shifts and the ratio of deviations."""
    s = pairs.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("raw", "refined") for n, f in (("mean", F.avg), ("median", lambda c: F.percentile(c, 0.5)), ("std", F.stddev_pop))))
    return s.select("*", (F.col("refined_mean") - F.col("raw_mean")).alias("mean_shift"), (F.col("refined_median") - F.col("raw_median")).alias("median_shift"), F.try_divide("refined_std", "raw_std").alias("std_ratio"))


# Tolerated worsening of each metric, absolute or relative to the baseline.
RULES = [("mae", "absolute", 0.01), ("rmse", "absolute", 0.05), ("building_mae", "absolute", 0.05), ("bias", "magnitude", 0.05), ("boundary_mae", "relative", 0.05), ("grad_mae", "relative", 0.10), ("seam_mae", "absolute", 0.02), ("negative_fraction", "absolute", 1e-4), ("calibration_mean_shift", "shift", 0.05)]


def acceptance(baseline: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each rule for each variant of long metrics: ``baseline(key, value)`` against ``candidates(variant, key, value)``.

    A rule without a finite value on either side is skipped and passes; so is a relative one on a baseline of 0 or less.
    """
    spark = candidates.sparkSession
    rules = F.broadcast(spark.createDataFrame(RULES, "key string, kind string, tolerance double"))
    known = lambda df, name: df.where(finite(F.col("value"))).withColumnRenamed("value", name)
    rows = candidates.select("variant").distinct().crossJoin(rules)  # nine rules
    rows = rows.join(known(candidates, "got"), ["variant", "key"], "left").join(known(baseline, "base"), "key", "left")
    got, base, tol, kind = F.col("got"), F.col("base"), F.col("tolerance"), F.col("kind")
    skipped = got.isNull() | ((kind != "shift") & base.isNull()) | ((kind == "relative") & (base <= 0))
    ok = F.when(kind == "absolute", got <= base + tol).when(kind == "magnitude", F.abs(got) <= F.abs(base) + tol).when(kind == "relative", got <= base * (1 + tol)).otherwise(F.abs(got) <= tol)
    return rows.select("variant", "key", "got", "base", "tolerance", F.coalesce(skipped, F.lit(False)).alias("skipped"), (F.coalesce(skipped, F.lit(False)) | F.coalesce(ok, F.lit(False))).alias("pass"))


def verdicts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("variant").agg(F.when(F.bool_and("pass"), "PASS").otherwise("FAIL").alias("verdict"), F.count_if(~F.col("pass")).alias("n_failed"), F.count_if("skipped").alias("n_skipped"))


def ablation_table(pairs: DataFrame, variant: str, base: str) -> DataFrame:
    """Errors of each variant on the tiles that the base variant has too, with its verdict against the base."""
    tiles = pairs.where(F.col(variant) == base).select("tile").distinct()
    m = metrics.pooled_metrics(pairs.join(tiles, "tile", "left_semi").withColumn("variant", F.col(variant)), "variant")
    long = long_metrics(m, {"mae": "mae", "rmse": "rmse", "bias": "bias", "neg_frac": "negative_fraction"}, "variant")
    return m.join(verdicts(acceptance(long.where(F.col("variant") == base).select("key", "value"), long)), "variant")


def long_metrics(wide: DataFrame, names: dict[str, str], *keys: str) -> DataFrame:
    """One row for each metric: columns ``names`` under their new names."""
    return wide.select(*keys, F.explode(F.create_map(*(x for c, n in names.items() for x in (F.lit(n), F.col(c))))).alias("key", "value"))


def dataset_stats(px: DataFrame, *keys: str) -> DataFrame:
    """Pooled statistics of finite heights, share of unlabelled pixels, and the spread of the scenes' means."""
    v = F.when(finite(F.col("z")), F.col("z"))
    s = px.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(*(F.lit(q) for q in (0.5, 0.95, 0.99)))).alias("p"), F.avg(F.col("ignored").cast("double")).alias("ignore_frac"))
    means = px.groupBy(*keys, "scene_id").agg(F.avg(v).alias("m")).groupBy(*keys).agg(F.stddev_pop("m").alias("tile_mean_spread"))
    return s.join(means, list(keys)).select(*keys, "n", "lo", "hi", "mean", "std", *(F.col("p")[i].alias(q) for i, q in enumerate(("p50", "p95", "p99"))), "ignore_frac", "tile_mean_spread")


def reference_card(dummies: DataFrame, *keys: str) -> DataFrame:
    """Floors and gates from constant baselines: must is the best of them, target 0.8 of its MAE and 0.9 of its RMSE, at three places."""
    best = lambda m: [F.min(m).alias(f"{m}_must"), F.min_by("baseline", F.struct(m, "baseline")).alias(f"{m}_from")]
    card = dummies.groupBy(*keys).agg(*best("mae"), *best("rmse"))
    return card.select("*", F.round(F.col("mae_must") * 0.8, 3).alias("mae_target"), F.round(F.col("rmse_must") * 0.9, 3).alias("rmse_target"))


def coverage(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """How much of each scene's valid reference a candidate covers; none at all is a grid mismatch."""
    ok = reference.where(finite(F.col("z"))).select(*KEYS)
    hit = candidate.where(finite(F.col("z"))).select(*KEYS, F.lit(1).alias("hit"))
    s = ok.join(hit, KEYS, "left").groupBy("scene_id").agg(F.count("*").alias("n_reference"), F.count("hit").alias("n_overlap"))
    return s.select("*", (F.col("n_overlap") / F.col("n_reference")).alias("overlap"), F.when(F.col("n_overlap") == 0, "GRID_MISMATCH").otherwise("OK").alias("status_code"))


def validation_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """RMSE, MAE, correlation (null where a side does not vary) and number of pairs that are finite on both sides."""
    s = metrics.pooled_metrics(pairs, *keys)
    return s.select(*keys, "n", "rmse", "mae", F.when(~F.isnan("r"), F.col("r")).alias("corr"))


def error_map(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return pred.select(*KEYS, F.col("z").alias("p")).join(truth.select(*KEYS, F.col("z").alias("t")), KEYS).select(*KEYS, (F.col("p") - F.col("t")).alias("error"))


def eval_absolute(pred: DataFrame, truth: DataFrame, gsd: float | None) -> DataFrame:
    """Coverage, errors and slope errors of each scene in one row; scenes that do not overlap keep their status and no figures."""
    pairs = pred.select(*KEYS, F.col("z").alias("pred")).join(truth.select(*KEYS, F.col("z").alias("truth")), KEYS)
    parts = [coverage(truth, pred), metrics.pooled_metrics(pairs, "scene_id").drop("n")]
    slopes = slope_error(pairs, gsd)
    if slopes is not None:
        parts.append(slopes.drop("n"))
    return reduce(lambda a, b: a.join(b, "scene_id", "left"), parts)


def gradient_loss(pairs: DataFrame) -> DataFrame:
    """Mean difference of first differences, rows and columns apart, over all finite ones."""
    parts = []
    for along, across in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("scene_id", across).orderBy(along)
        diff = lambda c: F.col(c) - F.lag(c).over(w)
        parts.append(pairs.select("scene_id", F.abs(diff("pred") - diff("truth")).alias("d")))
    both = parts[0].unionByName(parts[1]).where(finite(F.col("d")))
    return both.groupBy("scene_id").agg(F.avg("d").alias("gradient_loss"), F.count("*").alias("n"))


def slope_angle_loss(pairs: DataFrame, gsd: float) -> DataFrame:
    """Mean difference of slopes in radians, border left out."""
    angle = lambda side: F.atan(F.sqrt(F.pow(F.col(f"gx_{side}") / gsd, 2) + F.pow(F.col(f"gy_{side}") / gsd, 2) + 1e-8))
    d = _both_gradients(pairs).withColumn("d", F.abs(angle("pred") - angle("truth"))).where(finite(F.col("d")))
    return d.groupBy("scene_id").agg(F.avg("d").alias("slope_loss"))


def semantic_ce(logits: DataFrame, ignore: int = 255) -> DataFrame:
    """Mean cross-entropy of ``logits(scene_id, logits, target)`` over labelled pixels."""
    p = F.element_at(pixels.softmax(F.col("logits")), (F.col("target") + 1).cast("int"))
    return logits.where(F.col("target") != ignore).groupBy("scene_id").agg(F.avg(-F.ln(p)).alias("ce"), F.count("*").alias("n"))


def verify_tiles(px: DataFrame, size: int) -> DataFrame:
    """Each tile's first fault: missing pixels, no valid value, values beyond [0, 1] (by more than a millionth)."""
    v = F.when(finite(F.col("dn")), F.col("dn"))
    s = px.groupBy("scene_id", F.floor(F.col("row") / size).alias("tr"), F.floor(F.col("col") / size).alias("tc")).agg(F.count("*").alias("n"), F.count(v).alias("n_valid"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    reason = F.when(F.col("n") != size * size, "SHAPE").when(F.col("n_valid") == 0, "NO_VALID_DATA").when((F.col("lo") < -1e-6) | (F.col("hi") > 1 + 1e-6), "OUT_OF_RANGE").otherwise("OK")
    return s.select("scene_id", "tr", "tc", reason.alias("reason"))


def window_consistency(windows: DataFrame) -> DataFrame:
    """Mean difference of the values that neighbouring windows give the same pixel, each pair of windows once: ``windows(scene_id, window, row, col, z)``."""
    a, b = windows.alias("a"), windows.select("scene_id", "row", "col", F.col("window").alias("w2"), F.col("z").alias("z2"))
    pairs = a.join(b, KEYS).where("window < w2")
    return pairs.groupBy("scene_id").agg(F.avg(F.abs(F.col("z") - F.col("z2"))).alias("window_gap"), F.count("*").alias("n_pairs"))
