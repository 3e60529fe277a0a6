"""Damage and class decisions of objects from probabilities and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ["no-damage", "minor-damage", "major-damage", "destroyed"]


def damage_decision(probs: F.Column, least_margin: float = 0.15, least_conf: float = 0.4) -> tuple[F.Column, F.Column, F.Column]:
    """Label from 1 (no damage) to 4, its probability after renormalising, and whether a person should look: a small lead or low confidence."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) + 1e-8
    share = F.transform(probs, lambda p: p / total)
    order = F.sort_array(share, asc=False)
    top = F.element_at(order, 1)
    return F.array_position(share, F.array_max(share)).cast("int"), top, (top - F.element_at(order, 2) < least_margin) | (top < least_conf)


def crop_context(row0: F.Column, col0: F.Column, row1: F.Column, col1: F.Column, height: int, width: int, share: float = 0.25, least_pad: int = 16, least_crop: int = 64) -> dict[str, F.Column]:
    """A box with context: padded by a share of its sides, at least so many pixels, and clipped to the scene; a side that is still too short is widened at both ends by half of what it lacks and one, and clipped again."""
    def side(lo: F.Column, hi: F.Column, extent: int) -> tuple[F.Column, F.Column]:
        pad = F.greatest(((hi - lo) * share).cast("int"), F.lit(least_pad))
        a, b = F.greatest(lo - pad, F.lit(0)), F.least(hi + pad, F.lit(extent))
        more = F.when(b - a < least_crop, F.floor((F.lit(least_crop) - (b - a)) / 2).cast("int") + 1).otherwise(0)
        return F.greatest(a - more, F.lit(0)), F.least(b + more, F.lit(extent))

    (r0, r1), (c0, c1) = side(row0, row1, height), side(col0, col1, width)
    return {"row0": r0, "row1": r1, "col0": c0, "col1": c1}


def reconstruct_conf(mask: F.Column, boundary: F.Column, fit: F.Column, mad: F.Column, height: F.Column) -> F.Column:
    """Confidence in a reconstructed object."""
    spread = F.least(F.coalesce(F.try_divide(mad, height), F.lit(1.0)) / 0.5, F.lit(1.0))
    return 0.35 * mask + 0.25 * boundary + 0.20 * fit + 0.20 * (1 - spread)


def damage_vote(votes: DataFrame, least_share: float = 0.25) -> DataFrame:
    """Label of most pixels under each object of ``votes(object_id, label, conf)``; equal counts go to the lower label, a share under the least gives none."""
    n = votes.groupBy("object_id", "label").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"))
    best = n.groupBy("object_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("label")).alias("low"), "conf")).alias("b"))
    enough = F.col("b.n") >= least_share * F.col("total")
    return best.select("object_id", F.when(enough, -F.col("b.low")).alias("label"), F.when(enough, F.col("b.conf")).alias("conf"), (F.col("b.n") / F.col("total")).alias("share"))


def object_probs(px: DataFrame, n_classes: int) -> DataFrame:
    """Mean probabilities under each object; one without a pixel in its mask takes those of the central half of its box. ``px(object_id, inside, central, probs)``."""
    mean = lambda flag: F.array(*(F.avg(F.when(F.col(flag), F.col("probs")[i])) for i in range(n_classes)))
    s = px.groupBy("object_id").agg(mean("inside").alias("own"), mean("central").alias("middle"), F.count_if("inside").alias("n_inside"))
    return s.select("object_id", F.when(F.col("n_inside") > 0, F.col("own")).otherwise(F.col("middle")).alias("probs"), "n_inside")


def damage_summary(objects: DataFrame, *keys: str) -> DataFrame:
    """Counts of all four classes, absent ones too, of objects to review and of recovered ones, and mean confidence."""
    counts = [F.count_if(F.col("label") == i + 1).alias(name.replace("-", "_")) for i, name in enumerate(CLASSES)]
    return objects.groupBy(*keys).agg(*counts, F.count_if("review").alias("n_review"), F.count_if("recovered").alias("n_recovered"), F.avg("conf").alias("mean_conf"))


def semantic_summary(px: DataFrame, n_classes: int, low: float = 0.7) -> DataFrame:
    """Share of each class of a scene, mean confidence and the share of pixels below ``low``."""
    shares = [F.avg((F.col("label") == i).cast("double")).alias(f"class_{i}") for i in range(n_classes)]
    return px.groupBy("scene_id").agg(*shares, F.avg("conf").alias("mean_conf"), F.avg((F.col("conf") < low).cast("double")).alias("low_conf"))
