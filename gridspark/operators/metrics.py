"""Height errors and statistics: pooled, by tile, by stratum; gates; fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite, pearson, valid
from gridspark.operators.quantiles import percentiles


def inspect(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Counts of NaN, infinite, nodata and valid pixels of each scene, and min, max, mean of the valid ones (null if none)."""
    z, ok = F.col("z"), valid(F.col("z"), nodata)
    v = F.when(ok, z)
    return px.groupBy("scene_id").agg(
        F.count_if(F.isnan(z)).alias("n_nan"),
        F.count_if(F.abs(z) == float("inf")).alias("n_inf"),
        (F.count_if(z == nodata) if nodata is not None else F.lit(0)).alias("n_nodata"),
        F.count_if(ok).alias("n_valid"),
        F.min(v).alias("z_min"),
        F.max(v).alias("z_max"),
        F.avg(v).alias("z_mean"),
    )


def _sums() -> list:
    d, p, t = F.col("pred") - F.col("truth"), F.col("pred"), F.col("truth")
    return [F.count("*").alias("n"), F.sum(F.abs(d)).alias("sad"), F.sum(d).alias("sd"), F.sum(d * d).alias("sdd"), F.sum(p).alias("sp"), F.sum(t).alias("st"), F.sum(p * p).alias("spp"), F.sum(t * t).alias("stt"), F.sum(p * t).alias("spt"), F.sum((p < 0).cast("double")).alias("neg")]


def sums(pairs: DataFrame, *keys: str) -> DataFrame:
    """Ten mergeable sums of finite pairs(pred, truth): they add up over tiles, files and micro-batches."""
    return pairs.where(finite(F.col("pred")) & finite(F.col("truth"))).groupBy(*keys).agg(*_sums())


def from_sums(s: DataFrame, *keys: str) -> DataFrame:
    """Pooled errors from the ten sums."""
    n = F.col("n")
    return s.select(
        *keys,
        "n",
        (F.col("sad") / n).alias("mae"),
        F.sqrt(F.col("sdd") / n).alias("rmse"),
        (F.col("sd") / n).alias("bias"),
        pearson(n, F.col("sp"), F.col("st"), F.col("spp"), F.col("stt"), F.col("spt")).alias("r"),
        (F.col("neg") / n).alias("neg_frac"),
    )


def pooled_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    return from_sums(sums(pairs, *keys), *keys)


def height_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pooled errors with the exact median of absolute errors."""
    ok = pairs.where(finite(F.col("pred")) & finite(F.col("truth")))
    medians = F.percentile(F.abs(F.col("pred") - F.col("truth")), 0.5).alias("medae")
    return from_sums(ok.groupBy(*keys).agg(*_sums(), medians).withColumn("medae", F.col("medae")), *keys, "medae")


def mean_std_over_tiles(per_tile: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Mean and population deviation of each metric over tiles; values that are not finite are skipped."""
    out = []
    for m in metrics:
        v = F.when(finite(F.col(m)), F.col(m))
        out += [F.avg(v).alias(f"{m}_mean"), F.stddev_pop(v).alias(f"{m}_std")]
    return per_tile.groupBy(*keys).agg(*out, F.count("*").alias("n_tiles"))


def threshold_bands(pairs: DataFrame, limits: list[float], *keys: str) -> DataFrame:
    """Pooled errors where the truth exceeds each limit."""
    bands = F.filter(F.array(*(F.lit(float(x)) for x in limits)), lambda x: F.col("truth") > x)
    return pooled_metrics(pairs.select("*", F.explode(bands).alias("over")), *keys, "over")


def rollup_report(pairs: DataFrame) -> DataFrame:
    """Pooled errors of everything, by split, by city and by class, from one pass of grouping sets."""
    ok = pairs.where(finite(F.col("pred")) & finite(F.col("truth")))
    sets = ok.groupingSets([[], ["split"], ["city"], ["cls"]], "split", "city", "cls").agg(F.grouping_id().alias("g"), *_sums())
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "split").when(F.col("g") == 5, "city").otherwise("class")
    key = F.when(F.col("g") == 3, F.col("split")).when(F.col("g") == 5, F.col("city")).when(F.col("g") == 6, F.col("cls").cast("string"))
    return from_sums(sets.select("*", level.alias("level"), key.alias("key")), "level", "key")


def distribution(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """Range, mean, population deviation and exact percentiles of finite values."""
    q = [1, 5, 25, 50, 75, 95, 99, 99.9]
    v = F.col(column)
    agg = values.where(finite(v)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(*(F.lit(x / 100) for x in q))).alias("p"))
    return agg.select(*keys, "n", "lo", "hi", "mean", "std", *(F.col("p")[i].alias(f"p{x:g}".replace(".", "_")) for i, x in enumerate(q)))


def class_inventory(px: DataFrame, *keys: str) -> DataFrame:
    """Pixels and share of each class within each key."""
    n = px.groupBy(*keys, "cls").agg(F.count("*").alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else n.agg(F.sum("n").alias("total"))
    joined = n.join(total, list(keys)) if keys else n.crossJoin(F.broadcast(total))  # one row
    return joined.select(*keys, "cls", "n", (F.col("n") / F.col("total")).alias("share"))


def fit_affine(pairs: DataFrame, *keys: str) -> DataFrame:
    """Least squares of truth = a * pred + b from five sums; no variation of pred gives null."""
    s = sums(pairs, *keys)
    n = F.col("n")
    a = F.try_divide(n * F.col("spt") - F.col("sp") * F.col("st"), n * F.col("spp") - F.col("sp") * F.col("sp"))
    return s.select(*keys, "n", a.alias("a"), ((F.col("st") - a * F.col("sp")) / n).alias("b"))


def fit_affine_huber(pairs: DataFrame, delta: float = 1.0, start: tuple[float, float] = (0.15, -9.0), rounds: int = 100, tolerance: float = 1e-9) -> tuple[float, float]:
    """Huber fit of truth = a * pred + b by reweighted least squares: each round is one aggregation of five weighted sums."""
    a, b = start
    ok = pairs.where(finite(F.col("pred")) & finite(F.col("truth")))
    x, y = F.col("pred"), F.col("truth")
    for _ in range(rounds):
        e = F.abs(y - (x * a + b))
        w = F.when(e <= delta, 1.0).otherwise(delta / e)
        s = ok.agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy")).first()
        if not s["w"]:
            return a, b
        det = s["w"] * s["xx"] - s["x"] ** 2
        new = ((s["w"] * s["xy"] - s["x"] * s["y"]) / det if det else 0.0, 0.0)
        new = (new[0], (s["y"] - new[0] * s["x"]) / s["w"])
        if abs(new[0] - a) + abs(new[1] - b) < tolerance:
            return new
        a, b = new
    return a, b


def constant_baselines(pairs: DataFrame, train: str) -> DataFrame:
    """Errors by split of predicting 0, the training mean and the training median."""
    learnt = pairs.where((F.col("split") == train) & finite(F.col("truth")))
    fit = learnt.agg(F.avg("truth").alias("mean")).join(percentiles(learnt, ["split"], "truth", [0.5]).select(F.col("p")[0].alias("median")), how="left")  # one row each
    guesses = fit.select(F.explode(F.create_map(F.lit("zero"), F.lit(0.0), F.lit("mean"), F.col("mean"), F.lit("median"), F.col("median"))).alias("baseline", "guess"))
    return pooled_metrics(pairs.crossJoin(F.broadcast(guesses)).withColumn("pred", F.col("guess")), "baseline", "split")  # three rows


def gate_verdicts(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """``gates(key, must, target)`` against ``metrics(key, value)``: below must passes, at most target meets the target; no metric fails."""
    return gates.join(metrics, "key", "left").select("key", "value", "must", "target", F.coalesce(F.col("value") < F.col("must"), F.lit(False)).alias("passes"), F.coalesce(F.col("value") <= F.col("target"), F.lit(False)).alias("on_target"))


def scene_type(px: DataFrame, building: int = 6, vegetation: list[int] | None = None) -> DataFrame:
    """urban, forest, hilly, sparse or flat, from class shares and relief (p95 - p50; 0 for ten valid pixels or fewer)."""
    veg = F.col("cls").isin(vegetation or [5])
    ok = finite(F.col("z")) & (F.col("z") != -9999)
    v = F.when(ok, F.col("z"))
    s = px.groupBy("scene_id").agg(F.avg((F.col("cls") == building).cast("double")).alias("b"), F.avg(veg.cast("double")).alias("v"), F.count(v).alias("n"))
    s = s.join(percentiles(px.where(ok), ["scene_id"], "z", [0.5, 0.95]).drop("n"), "scene_id", "left")
    relief = F.when(F.col("n") > 10, F.col("p")[1] - F.col("p")[0]).otherwise(0.0)
    kind = F.when(F.col("b") >= 0.15, "urban").when(F.col("v") >= 0.5, "forest").when(relief >= 15, "hilly").when(F.col("b") >= 0.02, "sparse").otherwise("flat")
    return s.select("scene_id", F.col("b").alias("building_share"), F.col("v").alias("vegetation_share"), relief.alias("relief"), kind.alias("scene_type"))


def saturation(pairs: DataFrame, *keys: str) -> DataFrame:
    """Share of predictions at zero and of truths at half a metre or less."""
    return pairs.groupBy(*keys).agg(F.avg((F.col("pred") <= 1e-6).cast("double")).alias("pred_zero"), F.avg((F.col("truth") <= 0.5).cast("double")).alias("truth_low"))


def losses(pairs: DataFrame, *keys: str, delta: float = 1.0) -> DataFrame:
    """L1, Huber and height-balanced (x2 over 10 m, x5 over 30 m) losses as means."""
    e = F.abs(F.col("pred") - F.col("truth"))
    huber = F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))
    w = F.when(F.col("truth") > 30, 5.0).when(F.col("truth") > 10, 2.0).otherwise(1.0)
    ok = pairs.where(finite(F.col("pred")) & finite(F.col("truth")))
    return ok.groupBy(*keys).agg(F.avg(e).alias("l1"), F.avg(huber).alias("huber"), (F.sum(w * e) / F.sum(w)).alias("balanced"))


def tta_fuse(variants: DataFrame) -> DataFrame:
    """Median, mean and population spread of the values of each pixel over variants."""
    return variants.groupBy("scene_id", "row", "col").agg(F.percentile("z", 0.5).alias("z_median"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("spread"))
