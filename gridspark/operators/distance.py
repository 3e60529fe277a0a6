"""Exact nearest seeds whatever the distance: columns first, then lower envelopes of parabolas along rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANK = 1 << 40
"""More than the places of a scene: squared distances times this, plus a place, order by distance and then by place."""


def envelope(columns: list[int], offsets: list[int], scale: int) -> tuple[list[int], list[int]]:
    """Which of the parabolas ``scale * (x - c)^2 + offset`` is lowest, and from which x on; columns ascend and no two parabolas ever tie at a whole x."""
    own: list[int] = []
    start: list[int] = []
    for k, c in enumerate(columns):
        begin = None
        while own:
            j = own[-1]
            up = offsets[k] + scale * c * c - offsets[j] - scale * columns[j] * columns[j]
            begin = up // (2 * scale * (c - columns[j])) + 1
            if begin > start[-1]:
                break
            own.pop()
            start.pop()
            begin = None
        own.append(k)
        start.append(begin if begin is not None else columns[0] - _RANK)
    return own, start


def nearest_seed(px: DataFrame) -> DataFrame:
    """``(scene_id, row, col, seed_row, seed_col, d2)``: the seed nearest to each hot pixel of ``px(scene_id, row, col, hot, seed)``.

    Scenes hold a row for every pixel; null flags count as false. Equal distances go to the first seed in row-major order.
    A scene without a seed gives no row. Columns are windows that spill, rows are groups of one scene's width.
    """
    column = Window.partitionBy("scene_id", "col").orderBy("row")
    at = F.when(F.col("seed"), F.col("row"))
    up = F.last(at, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(at, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    near = px.select("scene_id", "row", "col", F.coalesce("hot", F.lit(False)).alias("hot"), up.alias("up"), down.alias("down"))
    nearest = F.when(F.col("down").isNull() | (F.col("row") - F.col("up") <= F.col("down") - F.col("row")), F.col("up")).otherwise(F.col("down"))
    near = near.select("scene_id", "row", "col", "hot", nearest.cast("long").alias("seed_row")).where("hot or seed_row is not null")
    asked = near.where("hot").select("scene_id", "row").distinct()
    near = near.join(asked.toDF("scene_id", "row"), ["scene_id", "row"], "left_semi")

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        row = key[1].as_py()
        cells = sorted(zip(table["col"].to_pylist(), table["seed_row"].to_pylist(), table["hot"].to_pylist()))
        seeds = [(c, s) for c, s, _ in cells if s is not None]
        columns = [c for c, _ in seeds]
        width = cells[-1][0] + 1
        own, start = envelope(columns, [_RANK * (row - s) ** 2 + s * width + c for c, s in seeds], _RANK)
        out, k = [], 0
        for x, _, hot in cells:
            while k + 1 < len(own) and start[k + 1] <= x:
                k += 1
            if hot and own:
                c, s = seeds[own[k]]
                out.append((x, s, c, (x - c) ** 2 + (row - s) ** 2))
        col, sr, sc, d2 = zip(*out) if out else ((), (), (), ())
        return pa.table({"scene_id": pa.array([key[0].as_py()] * len(out), pa.int64()), "row": pa.array([row] * len(out), pa.int32()), "col": pa.array(col, pa.int32()), "seed_row": pa.array(sr, pa.int32()), "seed_col": pa.array(sc, pa.int32()), "d2": pa.array(d2, pa.int64())})

    return near.groupBy("scene_id", "row").applyInArrow(apply, "scene_id long, row int, col int, seed_row int, seed_col int, d2 long")
