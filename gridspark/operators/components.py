"""Connected components of masks and the objects they make.

Pixels are labelled within chunks first; only labels that meet across borders of chunks go into the rounds of star
contraction. A label is the place of a component's first pixel in row-major order, so it depends on no chunk size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.runs import whole_groups
from gridspark.plans.graph import connected_components
from gridspark.plans.lineage import cut

CHUNK = 256
KEYS = ["scene_id", "row", "col"]


def _local_labels(mask: np.ndarray, conn: int) -> np.ndarray:
    """Smallest place of each component of a small array, by taking the least of neighbours along runs until nothing changes."""
    big = mask.size
    lab = np.where(mask, np.arange(mask.size).reshape(mask.shape), big)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    h, w = mask.shape
    while True:
        before = lab.copy()
        for dr, dc in steps:
            a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
            b = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
            low = np.where(mask[a] & mask[b], np.minimum(lab[a], lab[b]), big)
            lab[a] = np.where(mask[a], np.minimum(lab[a], low), big)
            lab[b] = np.where(mask[b], np.minimum(lab[b], low), big)
        own = np.append(lab.ravel(), big)
        lab = np.where(mask, np.minimum(lab, own[lab]), big)  # jump to the label's label
        if (lab == before).all():
            return lab


def _labels_at_once(chunk_of: np.ndarray, row: np.ndarray, col: np.ndarray, chunk: int, conn: int) -> np.ndarray:
    """For pixels sorted by chunk, row and column within it the place of the first pixel of their component in their chunk.

    Neighbours are looked up, so it takes memory for pixels only. A label hooks on to the least that it meets and all labels then
    follow to their end, until those of no two neighbours differ.
    """
    wide = chunk + 1
    place = (chunk_of.astype(np.int64) * wide + row) * wide + col
    lab = np.arange(len(place))
    a, b = [], []
    for step in (1, wide) + ((wide + 1, wide - 1) if conn == 8 else ()):
        at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        met = np.flatnonzero(place[at] == place + step)
        a.append(met)
        b.append(at[met])
    a, b = np.concatenate(a), np.concatenate(b)
    while True:
        u, v = lab[a], lab[b]
        apart = u != v
        if not apart.any():
            return lab
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(lab, np.maximum(u, v), np.minimum(u, v))
        while (lab[lab] != lab).any():
            lab = lab[lab]


def label_components(mask: DataFrame, conn: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, row, col, label_row, label_col)`` of each pixel of ``mask(scene_id, row, col)``, over 4 or 8 neighbours; single pixels are components too."""
    of = ["scene_id", "cr", "cc"]
    px = mask.select(*KEYS, F.floor(F.col("row") / chunk).alias("cr"), F.floor(F.col("col") / chunk).alias("cc"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, of):
            row, col = table["row"].to_numpy(), table["col"].to_numpy()
            chunk_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
            once = np.ones(len(row), bool)
            once[1:] = (np.diff(chunk_of) != 0) | (np.diff(row) != 0) | (np.diff(col) != 0)
            table, row, col, chunk_of = table.filter(pa.array(once)), row[once], col[once], chunk_of[once]
            at = _labels_at_once(chunk_of, row - table["cr"].to_numpy() * chunk, col - table["cc"].to_numpy() * chunk, chunk, conn)
            own = pa.table({"scene_id": table["scene_id"], "row": table["row"], "col": table["col"], "lr": pa.array(row[at], pa.int32()), "lc": pa.array(col[at], pa.int32())})
            yield from own.to_batches()

    # chunks meet whole, many to a task, and are labelled as arrays
    local = cut(px.repartition(*of).sortWithinPartitions(*of, "row", "col").mapInArrow(apply, "scene_id long, row int, col int, lr int, lc int"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if conn == 8 else [])
    edge = (F.col("row") % chunk).isin(0, chunk - 1) | (F.col("col") % chunk).isin(0, chunk - 1)
    node = F.struct("scene_id", F.col("lr").alias("row"), F.col("lc").alias("col"))
    rim = local.where(edge)
    go = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps)))
    asked = rim.select(*KEYS, node.alias("u"), go.alias("o")).select("scene_id", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "u")
    links = asked.join(rim.select(*KEYS, node.alias("v")), KEYS).where("u <> v").select("u", "v").distinct()
    joined = connected_components(links).select(F.col("node.scene_id").alias("scene_id"), F.col("node.row").alias("lr"), F.col("node.col").alias("lc"), F.col("component.row").alias("label_row"), F.col("component.col").alias("label_col"))
    return local.join(joined, ["scene_id", "lr", "lc"], "left").select(*KEYS, F.coalesce("label_row", "lr").alias("label_row"), F.coalesce("label_col", "lc").alias("label_col"))


LABEL = ["scene_id", "label_row", "label_col"]


def filter_components(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of components of ``least`` pixels or more."""
    large = labels.groupBy(*LABEL).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*LABEL)
    return labels.join(large, LABEL, "left_semi")


def largest_components(labels: DataFrame, k: int) -> DataFrame:
    """The k largest components of each scene with their place; equal ones in row-major order of their first pixel."""
    n = labels.groupBy(*LABEL).agg(F.count("*").alias("area"))
    place = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("area"), "label_row", "label_col"))
    return n.withColumn("place", place).where(F.col("place") <= k)


def fill_holes(mask: DataFrame, every: DataFrame, height: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """The mask with its holes: parts of the background of ``every`` (all pixels) that do not meet the scene's border over four neighbours."""
    back = label_components(every.select(*KEYS).join(mask.select(*KEYS), KEYS, "left_anti"), 4, chunk)
    border = F.col("row").isin(0, height - 1) | F.col("col").isin(0, width - 1)
    outside = back.where(border).select(*LABEL).distinct()
    return mask.select(*KEYS).unionByName(back.join(outside, LABEL, "left_anti").select(*KEYS)).distinct()


def extract_objects(labels: DataFrame, values: DataFrame, least: int = 25) -> DataFrame:
    """Area, centroid, box and largest confidence of each component of ``least`` pixels or more, numbered B001, B002 ... in each scene by first pixel. ``values(scene_id, row, col, conf)``; boxes end before ``row1`` and ``col1``."""
    s = labels.join(values.select(*KEYS, "conf"), KEYS).groupBy(*LABEL).agg(
        F.count("*").alias("area"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), F.max("conf").alias("max_conf"),
        F.min("row").alias("row0"), (F.max("row") + 1).alias("row1"), F.min("col").alias("col0"), (F.max("col") + 1).alias("col1"),
    ).where(F.col("area") >= least)
    number = F.row_number().over(Window.partitionBy("scene_id").orderBy("label_row", "label_col"))
    return s.select("*", F.concat(F.lit("B"), F.lpad(number.cast("string"), 3, "0")).alias("object_id"))


def reachable(labels: DataFrame, starts: DataFrame) -> DataFrame:
    """Pixels of the component in which each of ``starts(point_id, scene_id, row, col)`` lies; a start outside the mask reaches none."""
    own = starts.join(labels, KEYS).select("point_id", *LABEL)
    return own.join(labels, LABEL).select("point_id", "scene_id", "row", "col")


def object_height(labels: DataFrame, px: DataFrame, ring: DataFrame) -> DataFrame:
    """Height of each component over its surroundings: ``(*label, n, base, height, median, mad, p10, p90)``.

    The base is the 20th percentile of the ring (``ring``: label and pixels), 0 without a valid value there. Over the base,
    the height is the median of the values inside that lie within three scaled deviations (MAD x 1.4826) of their median, of all if they do not
    deviate; median, mad (scaled), the 10th and 90th percentile and n are those of all values inside.
    """
    ok = px.where(~F.isnan("z")).select(*KEYS, "z")
    base = ring.join(ok, KEYS).groupBy(*LABEL).agg(F.percentile("z", 0.2).alias("base"))
    inside = labels.join(ok, KEYS).join(base, LABEL, "left").select(*LABEL, F.coalesce("base", F.lit(0.0)).alias("base"), (F.col("z") - F.coalesce("base", F.lit(0.0))).alias("rel"))
    own = inside.groupBy(*LABEL, "base").agg(F.percentile("rel", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("p"), F.count("*").alias("n"))
    far = inside.join(own.select(*LABEL, "p"), LABEL).select(*LABEL, "rel", F.abs(F.col("rel") - F.col("p")[0]).alias("far"))
    mad = far.groupBy(*LABEL).agg((F.percentile("far", 0.5) * 1.4826).alias("mad"))
    top = far.join(mad, LABEL).where("mad <= 1e-6 or far <= 3 * mad").groupBy(*LABEL).agg(F.percentile("rel", 0.5).alias("height"))
    return own.join(mad, LABEL).join(top, LABEL).select(*LABEL, "n", "base", "height", F.col("p")[0].alias("median"), "mad", F.col("p")[1].alias("p10"), F.col("p")[2].alias("p90"))
