"""Upper levels of objects: heights of each object in two clusters, many objects at once as arrays, large ones by rounds of sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite
from gridspark.functions.runs import whole_groups
from gridspark.operators.components import CHUNK, KEYS, LABEL, label_components
from gridspark.operators.quantiles import BOUND, percentiles
from gridspark.plans.lineage import cut

GAP, SHARE, LEAST_AREA, ROUNDS, LEAST_VALUES = 2.0, 0.15, 100, 24, 30  # fixed values
PART = ["part_row", "part_col"]


def _rounds(v: np.ndarray, first: np.ndarray, gap: float, rounds: int) -> tuple[np.ndarray, ...]:
    """The rounds of ``two_means`` for the objects whose values begin at ``first``: place of the object in ``first``, n, n_up, c_lo, c_hi."""
    n = np.diff(first, append=len(v))
    lo, hi = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    fit = (n >= LEAST_VALUES) & (hi - lo >= gap)
    out, own = [], np.flatnonzero(fit)
    v, n = v[np.repeat(fit, n)], n[fit]
    a, b, n_up = lo[fit] + 0.25 * (hi - lo)[fit], lo[fit] + 0.75 * (hi - lo)[fit], np.zeros(len(n), np.int64)
    for _ in range(rounds):
        if not len(n):
            break
        first, at = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        upper = np.abs(v - a[at]) > np.abs(v - b[at])
        n_up = np.add.reduceat(upper.astype(np.int64), first)
        both = (n_up > 0) & (n_up < n)
        low, high = (np.add.reduceat(np.where(side, v, 0.0), first) / np.maximum(k, 1) for side, k in ((~upper, n - n_up), (upper, n_up)))
        rests = (np.abs(low - a) < 1e-3) & (np.abs(high - b) < 1e-3)
        done, on = both & rests, both & ~rests
        out.append((own[done], n[done], n_up[done], a[done], b[done]))
        v = v[on[at]]
        own, n, n_up, a, b = own[on], n[on], n_up[on], low[on], high[on]
    out.append((own, n, n_up, a, b))
    return tuple(np.concatenate(x) for x in zip(*out))


def two_means(rel: DataFrame, gap: float = GAP, rounds: int = ROUNDS, bound: int = BOUND) -> DataFrame:
    """``(*label, n, n_up, c_lo, c_hi)``: two clusters of ``rel(*label, rel)`` for each object of 30 values or more that span ``gap``.

    The centres start at a quarter and three quarters of the range; a value midway belongs to the lower one. An object is done when both
    move by less than 0.001 (that move is not made); one whose values all fall to one centre has no clusters. Objects of up to ``bound`` values
    have all rounds in one task, many objects at once. For larger ones, of which there are few, a round is one pass over their values, with two sums an object.
    """
    sizes = rel.groupBy(*LABEL).agg(F.count("*").alias("n"), F.min("rel").alias("lo"), F.max("rel").alias("hi")).where(F.col("n") > bound)
    large = cut(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, LABEL):
            at, *found = _rounds(table["rel"].to_numpy(), first, gap, rounds)
            label = table.select(LABEL).take(pa.array(first[at])).combine_chunks()
            told = pa.table([*label.columns, *(pa.array(x) for x in found)], names=[*LABEL, "n", "n_up", "c_lo", "c_hi"])
            yield from told.to_batches()

    small = rel.where("rel is not null").join(F.broadcast(large), LABEL, "left_anti")
    # sorted by value too, so sums do not depend on the order of rows
    done = small.select(*LABEL, "rel").repartition(*LABEL).sortWithinPartitions(*LABEL, "rel").mapInArrow(run, "scene_id long, label_row int, label_col int, n long, n_up long, c_lo double, c_hi double")
    span = F.col("hi") - F.col("lo")
    state = cut(large.where((F.col("n") >= LEAST_VALUES) & (span >= gap)).select(*LABEL, "n", F.lit(0).cast("long").alias("n_up"), (F.col("lo") + 0.25 * span).alias("c_lo"), (F.col("lo") + 0.75 * span).alias("c_hi"), F.lit(True).alias("moves")))
    if state.isEmpty():
        return done
    upper = F.abs(F.col("rel") - F.col("c_lo")) > F.abs(F.col("rel") - F.col("c_hi"))
    values = cut(rel.join(F.broadcast(large.select(*LABEL)), LABEL, "left_semi"))
    for _ in range(rounds):
        active = state.where("moves")
        if active.isEmpty():
            break
        sums = values.join(F.broadcast(active.drop("n_up")), LABEL).groupBy(*LABEL, "n", "c_lo", "c_hi").agg(F.count_if(upper).alias("n_up"), F.avg(F.when(~upper, F.col("rel"))).alias("lo"), F.avg(F.when(upper, F.col("rel"))).alias("hi"))
        rests = (F.abs(F.col("lo") - F.col("c_lo")) < 1e-3) & (F.abs(F.col("hi") - F.col("c_hi")) < 1e-3)
        moved = sums.where((F.col("n_up") > 0) & (F.col("n_up") < F.col("n"))).select(*LABEL, "n", "n_up", F.when(rests, F.col("c_lo")).otherwise(F.col("lo")).alias("c_lo"), F.when(rests, F.col("c_hi")).otherwise(F.col("hi")).alias("c_hi"), (~rests).alias("moves"))
        state = cut(state.where(~F.col("moves")).unionByName(moved))
    return done.unionByName(state.drop("moves"))


def _is_core() -> Column:
    """Whether all four neighbours of a pixel are among the rows."""
    met = lambda along, across: (F.lag(along).over(w := Window.partitionBy("scene_id", across).orderBy(along)) == F.col(along) - 1) & (F.lead(along).over(w) == F.col(along) + 1)
    return F.coalesce(met("col", "row") & met("row", "col"), F.lit(False))


def object_levels(labels: DataFrame, px: DataFrame, objects: DataFrame, gap: float = GAP, share: float = SHARE, least: int = LEAST_AREA, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The upper levels of ``objects(*label, base, height)``: ``(*label, part_row, part_col, level_height, pixel_count)``, and their pixels.

    Heights over the base are split by ``two_means``; centres must lie ``gap`` apart, and the upper one must hold ``share`` of the values and
    ``least`` pixels. Of the parts of the pixels over the middle of both centres (four neighbours) the two largest count (equal ones: the last by first pixel) if they
    have ``least`` pixels and their median, without their rim where that leaves any and they have over 12 pixels, lies more than half a gap over the object's height.
    A part is named by its first pixel. Invalid heights take no part.
    """
    own = labels.join(px.where(finite(F.col("z"))).select(*KEYS, "z"), KEYS).join(objects.select(*LABEL, "base"), LABEL)
    rel = cut(own.select(*KEYS, *LABEL[1:], (F.col("z") - F.col("base")).alias("rel")))
    split = two_means(rel, gap).where((F.col("c_hi") - F.col("c_lo") >= gap) & (F.col("n_up") / F.col("n") >= share)).select(*LABEL, (0.5 * (F.col("c_lo") + F.col("c_hi"))).alias("middle"))
    upper = cut(rel.join(split, LABEL).where("rel > middle").drop("middle"))
    named = label_components(upper, 4, chunk).withColumnsRenamed({"label_row": "part_row", "label_col": "part_col"})
    parts = cut(upper.join(named, KEYS))  # two objects never touch over four neighbours, so no part is of both
    order = F.row_number().over(Window.partitionBy(*LABEL).orderBy(F.desc("pixel_count"), F.desc("part_row"), F.desc("part_col")))
    kept = cut(parts.groupBy(*LABEL, *PART).agg(F.count("*").alias("pixel_count")).withColumn("place", order).where((F.col("place") <= 2) & (F.col("pixel_count") >= least)).drop("place"))
    pixels = cut(parts.join(kept, [*LABEL, *PART]).withColumn("core", _is_core() & (F.col("pixel_count") > 12)))
    core = pixels.where("core")
    rim = pixels.join(core.select(*LABEL, *PART).distinct(), [*LABEL, *PART], "left_anti")
    height = percentiles(core.unionByName(rim), [*LABEL, *PART], "rel", [0.5]).select(*LABEL, *PART, F.col("p")[0].alias("level_height"))
    levels = kept.join(height, [*LABEL, *PART]).join(objects.select(*LABEL, "height"), LABEL).where(F.col("level_height") > F.col("height") + 0.5 * gap).select(*LABEL, *PART, "level_height", "pixel_count")
    return levels, pixels.join(levels.select(*LABEL, *PART), [*LABEL, *PART], "left_semi").select(*KEYS, *LABEL[1:], *PART)
