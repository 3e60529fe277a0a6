"""Pyramids of height tiles: each level is made from the one below it, only the deepest from pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.tiling import quadtree_window
from gridspark.plans.lineage import cut

BLANK = 32768
"""Code of a cell without a value, and of all cells of a flat scene: the middle of 0 to 65535."""
_SLACK = 1e-9


def _edge(k: Column, extent: str, z: int) -> Column:
    """First pixel of tile k of an axis (half to even)."""
    return F.rint(k * F.col(extent) / (1 << z)).cast("int")


def _window(k: Column, extent: str, z: int) -> tuple[Column, Column]:
    lo = _edge(k, extent, z)
    return lo, F.greatest(_edge(k + 1, extent, z), lo + 1)


def _cells(a: Column, b: Column, lo: Column, hi: Column, size: int) -> Column:
    """``array<struct<cell, share>>``: the cells of a tile from lo to hi that a piece from a to b meets, and the share of the piece in each."""
    step = (hi - lo) / F.lit(float(size))
    first = F.greatest(F.floor((a - lo) / step + _SLACK), F.lit(0)).cast("int")
    last = F.least(F.ceil((b - lo) / step - _SLACK) - 1, F.lit(size - 1)).cast("int")
    share = lambda i: (F.least(b, lo + (i + 1) * step) - F.greatest(a, lo + i * step)) / (b - a)
    met = F.filter(F.transform(F.sequence(first, F.greatest(last, first)), lambda i: F.struct(i.alias("cell"), share(i).alias("share"))), lambda x: x["share"] > _SLACK)
    return F.when((last >= first) & (first < size), met)


def _gathered(pieces: DataFrame, z: int, size: int) -> DataFrame:
    """Sums of a level's cells from pieces ``(scene_id, height, width, y, x, r0, r1, c0, c1, wz, w)`` dealt to its tiles."""
    rows = pieces.select("*", F.explode(_cells(F.col("r0"), F.col("r1"), *_window(F.col("y"), "height", z), size)).alias("i"))
    both = rows.select("*", F.explode(_cells(F.col("c0"), F.col("c1"), *_window(F.col("x"), "width", z), size)).alias("j"))
    part = F.col("i.share") * F.col("j.share")
    return both.groupBy("scene_id", "height", "width", "y", "x", F.col("i.cell").alias("i"), F.col("j.cell").alias("j")).agg(F.sum(F.col("wz") * part).alias("wz"), F.sum(F.col("w") * part).alias("w"))


def _tiles_at(at: str, extent: str, z: int) -> Column:
    """The tiles of an axis whose window holds a pixel: one, or several where tiles are more than pixels."""
    n = 1 << z
    near = F.sequence(F.greatest(F.floor(F.col(at) * n / F.col(extent)) - 1, F.lit(0)), F.least(F.ceil((F.col(at) + 1) * n / F.col(extent)) + 1, F.lit(n - 1)))

    def holds(k: Column) -> Column:
        lo, hi = _window(k, extent, z)
        return (lo <= F.col(at)) & (F.col(at) < hi)

    return F.explode(F.filter(near, holds))


def _pieces_above(cells: DataFrame, z: int, size: int) -> DataFrame:
    """Cells of level z + 1 as pieces of the tiles of level z. Of tiles beyond the pixels, whose windows are one pixel that
    is another tile's too, only the first of a tile that is one itself counts."""
    deep = z + 1

    def counts(k: str, extent: str) -> Column:
        up = F.floor(F.col(k) / 2)
        own, above = _edge(F.col(k), extent, deep) < _edge(F.col(k) + 1, extent, deep), _edge(up, extent, z) < _edge(up + 1, extent, z)
        return own | (~above & (F.col(k) % 2 == 0))

    def piece(k: str, cell: str, extent: str) -> tuple[Column, Column]:
        lo, hi = _window(F.col(k), extent, deep)
        return lo + F.col(cell) * (hi - lo) / F.lit(float(size)), lo + (F.col(cell) + 1) * (hi - lo) / F.lit(float(size))

    (r0, r1), (c0, c1) = piece("y", "i", "height"), piece("x", "j", "width")
    kept = cells.where(counts("y", "height") & counts("x", "width"))
    return kept.select("scene_id", "height", "width", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"), "wz", "w")


def pyramid(px: DataFrame, scenes: DataFrame, deepest: int, size: int) -> DataFrame:
    """``(scene_id, z, y, x, i, j, height, code)``: every cell of the size x size tiles of levels 0 to ``deepest``.

    ``px(scene_id, row, col, z)`` has heights, null and not finite ones without weight; ``scenes(scene_id, height, width)``
    has a row for each scene. A cell is the mean of the deepest level's pixels by their area in it, so a tile with fewer pixels
    than cells repeats them; each level above is the mean of the cells of the one below. Codes run from 0 to 65535 between
    the least and the largest height of the whole scene. A cell without a height, or of a window beyond the scene, has a null
    height and the middle code, as all cells of a scene with a range under 1e-6 have the middle code.
    """
    if deepest < 0 or size < 1:
        raise ValueError("deepest is at least 0, size at least 1")
    extents = scenes.select("scene_id", "height", "width")
    valid = F.coalesce(F.abs("z") < float("inf"), F.lit(False))
    sized = px.select("scene_id", "row", "col", F.when(valid, F.col("z").cast("double")).otherwise(0.0).alias("wz"), valid.cast("double").alias("w")).join(extents, "scene_id")
    dealt = sized.select("*", _tiles_at("row", "height", deepest).alias("y")).select("*", _tiles_at("col", "width", deepest).alias("x"))
    edge = lambda c, more: (F.col(c) + more).cast("double")
    pieces = dealt.select("scene_id", "height", "width", "y", "x", edge("row", 0).alias("r0"), edge("row", 1).alias("r1"), edge("col", 0).alias("c0"), edge("col", 1).alias("c1"), "wz", "w")
    levels = [cut(_gathered(pieces, deepest, size))]
    for z in range(deepest - 1, -1, -1):
        levels.append(cut(_gathered(_pieces_above(levels[-1], z, size), z, size)))
    made = reduce(DataFrame.unionByName, [df.select("scene_id", F.lit(z).alias("z"), "y", "x", "i", "j", F.when(F.col("w") > 0, F.col("wz") / F.col("w")).alias("height")) for z, df in zip(range(deepest, -1, -1), levels)])
    cell = lambda: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    blank = []
    for z in range(deepest + 1):
        beyond = quadtree_window(extents.where(F.least("height", "width") < (1 << z)), z).join(extents, "scene_id").where((F.col("row0") >= F.col("height")) | (F.col("col0") >= F.col("width")))
        blank.append(beyond.select("scene_id", "z", "y", "x", cell().alias("i")).select("*", cell().alias("j")).withColumn("height", F.lit(None).cast("double")))
    span = px.where(valid).groupBy("scene_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    out = reduce(DataFrame.unionByName, [made, *blank]).join(span, "scene_id", "left")
    share = (F.col("height") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    code = F.when(F.col("height").isNull() | (F.col("hi") - F.col("lo") < 1e-6), BLANK).otherwise(F.rint(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 65535))
    ints = [F.col(c).cast("int").alias(c) for c in ("z", "y", "x", "i", "j")]
    return out.select("scene_id", *ints, "height", code.cast("int").alias("code"))
