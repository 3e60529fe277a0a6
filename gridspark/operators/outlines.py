"""Outlines of components: border sides of pixels, chained within chunks and joined to rings across them by doubling.

A side runs clockwise around its pixel (right along the top, down, left, up), so what it borders lies to its right. Which
side follows is told by the eight neighbours alone; where pixels meet only at a corner the ring stays with its pixel. A chunk
chains its own sides; only chains, not sides, go through the rounds, which are logarithmic in the chunks that a ring crosses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.components import CHUNK, LABEL
from gridspark.plans.lineage import cut, forget

_STEP = [(0, 1), (1, 0), (0, -1), (-1, 0)]
"""Rows and columns of a step right, down, left and up; a pixel's side k runs that way, and its outer side lies a step k - 1 away."""


def _side(row, col, k):
    """Sides in row-major order of their pixels, the top one first."""
    return (np.asarray(row, np.int64) << 34) | (np.asarray(col, np.int64) << 2) | k


def _chains(labels: DataFrame, chunk: int) -> DataFrame:
    """Each border side with its chain (named by its first side), place in it, the side that follows the chain's last, and whether it ends in a corner."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / chunk), F.floor((F.col(c) + 1) / chunk)))
    sent = labels.select("scene_id", "row", "col", *LABEL[1:], span("row").alias("cr")).select("*", span("col").alias("cc"))

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        row, col, lr, lc = (table[c].to_numpy().astype(np.int64) for c in ("row", "col", *LABEL[1:]))
        core = (row // chunk == key[1].as_py()) & (col // chunk == key[2].as_py())
        r0, c0 = row.min() - 1, col.min() - 1
        own = np.full((row.max() - r0 + 2, col.max() - c0 + 2), -1, np.int64)
        own[row - r0, col - c0] = lr << 32 | lc
        r, c, label = row[core], col[core], (lr << 32 | lc)[core]
        like = lambda a, b: own[r + a - r0, c + b - c0] == label
        side, follow, name = [], [], []
        for k, (a, b) in enumerate(_STEP):
            left = _STEP[k - 1]
            ahead, beyond = like(a, b), like(a + left[0], b + left[1])
            straight = ahead & ~beyond
            turn = ahead & beyond
            nr, nc = r + np.where(ahead, a, 0) + np.where(turn, left[0], 0), c + np.where(ahead, b, 0) + np.where(turn, left[1], 0)
            nk = np.where(straight, k, np.where(turn, (k + 3) % 4, (k + 1) % 4))
            border = ~like(*left)
            side.append(_side(r, c, k)[border])
            follow.append(_side(nr, nc, nk)[border])
            name.append(label[border])
        side, follow, name = (np.concatenate(x).tolist() for x in (side, follow, name))
        after, label_of = dict(zip(side, follow)), dict(zip(side, name))
        out = []
        seen: set[int] = set()
        begins = sorted(set(side) - set(follow)) + sorted(side)  # open chains first, then closed ones from their least side
        for first in begins:
            if first in seen:
                continue
            at, pos = first, 0
            while at in after and at not in seen:
                seen.add(at)
                nxt = after[at]
                out.append((label_of[at], at, first, pos, None if nxt in after and nxt not in seen else nxt, (nxt & 3) != (at & 3)))
                at, pos = nxt, pos + 1
        columns = list(zip(*out)) if out else [[]] * 6
        names = np.array(columns[0], np.int64)
        return pa.table({"scene_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "label_row": pa.array((names >> 32).astype(np.int32)), "label_col": pa.array((names & 0xFFFFFFFF).astype(np.int32)), **{n: pa.array(v, t) for n, v, t in zip(("side", "chain", "pos", "follow", "corner"), columns[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))}})

    return sent.groupBy("scene_id", "cr", "cc").applyInArrow(apply, "scene_id long, label_row int, label_col int, side long, chain long, pos long, follow long, corner boolean")


def polygonize(labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, label_row, label_col, ring, outer, seq, x, y)``: the corners of all rings of ``labels`` (four neighbours), in pixel corners.

    A ring starts with the first corner from the begin of its first side in row-major order on and runs clockwise if it is the component's outer one, else (a hole)
    the other way; its last corner joins its first. ``ring`` counts from 0, the outer ring, in order of their starts. A row
    for each corner; an empty table gives none.
    """
    sides = cut(_chains(labels, chunk))
    chains = sides.groupBy("scene_id", "chain").agg(F.count("*").alias("n"), F.max("follow").alias("next"), F.min("side").alias("low"))
    chains = cut(chains)
    now = chains.select("scene_id", "chain", "next", "low")
    temporary = None
    while True:  # the least side of each ring: twice as many chains in each round
        on = now.select("scene_id", F.col("chain").alias("next"), F.col("next").alias("further"), F.col("low").alias("low_there"))
        step = now.join(on, ["scene_id", "next"]).select("scene_id", "chain", F.col("further").alias("next"), F.least("low", "low_there").alias("low"), (F.col("low_there") < F.col("low")).alias("fell"))
        step = cut(step)
        if temporary is not None:
            forget(temporary)
        temporary, now = step, step.drop("fell")
        if not step.where("fell").limit(1).count():
            break
    rings = chains.drop("low").join(now.select("scene_id", "chain", "low"), ["scene_id", "chain"])
    head = sides.select("scene_id", F.col("side").alias("low"), F.col("chain").alias("first"), F.col("pos").alias("first_pos"))
    rings = cut(rings.join(head, ["scene_id", "low"]))
    # how far it is from each chain's begin to the end of its ring, which is cut before the first chain
    rank = rings.select("scene_id", "chain", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), F.col("n").alias("left"))
    while True:
        on = rank.select("scene_id", F.col("chain").alias("next"), F.col("next").alias("further"), F.col("left").alias("left_there"))
        rank = cut(rank.join(on, ["scene_id", "next"], "left").select("scene_id", "chain", F.col("further").alias("next"), (F.col("left") + F.coalesce("left_there", F.lit(0))).alias("left")))
        if not rank.where("next is not null").limit(1).count():
            break
    size = rings.groupBy("scene_id", "low").agg(F.sum("n").alias("size"))
    place = rings.join(rank.select("scene_id", "chain", "left"), ["scene_id", "chain"]).join(size, ["scene_id", "low"])
    corner = sides.where("corner").join(place.select("scene_id", "chain", "low", "left", "size", "first_pos"), ["scene_id", "chain"])
    k, row, col = F.col("side").bitwiseAND(3), F.shiftright("side", 34), F.shiftright("side", 2).bitwiseAND((1 << 32) - 1)
    # the end of a side: where the next begins
    x, y = col + F.when(k.isin(0, 1), 1).otherwise(0), row + F.when(k.isin(1, 2), 1).otherwise(0)
    at = F.pmod(F.col("size") - F.col("left") + F.col("pos") + 1 - F.col("first_pos"), F.col("size"))
    outer = F.col("low") == F.shiftleft(F.col("label_row").cast("long"), 34) + F.shiftleft(F.col("label_col").cast("long"), 2)
    corners = cut(corner.select("scene_id", "label_row", "label_col", "low", outer.alias("outer"), at.alias("at"), x.cast("int").alias("x"), y.cast("int").alias("y")))
    number = F.row_number().over(Window.partitionBy(*LABEL).orderBy("low")) - 1
    named = corners.select(*LABEL, "low").distinct().select(*LABEL, "low", number.alias("ring"))
    seq = F.row_number().over(Window.partitionBy(*LABEL, "low").orderBy("at")) - 1
    return corners.join(named, [*LABEL, "low"]).select(*LABEL, "ring", "outer", seq.alias("seq"), "x", "y")
