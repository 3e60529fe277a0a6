"""Tiles put together as they arrive: a chunk of a scene leaves once every window over it has come.

State is kept a chunk, not a scene, so a group is bounded by the size of a chunk whatever the size of scenes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK = 256
PART = "scene_id long, cr int, cc int, tile long, expected int, h int, w int, top int, left int, ph int, pw int, wz binary, wt binary"
OUT = "scene_id long, cr int, cc int, height int, width int, data array<double>"


def _starts(extent: int, size: int, stride: int) -> np.ndarray:
    last = max(extent - size, 0)
    return np.unique(np.append(np.arange(0, last + 1, stride), last))


def _weights(size: int, overlap: int) -> np.ndarray:
    taper = min(overlap, size // 2)
    if taper < 2:
        return np.ones(size)
    d = np.minimum(np.arange(size), size - 1 - np.arange(size))
    return np.maximum(np.where(d < taper, 0.5 - 0.5 * np.cos(np.pi * d / (taper - 1)), 1.0), 1e-3)


def parts(tiles: DataFrame, size: int, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """What each of ``tiles(scene_id, height, width, ri, ci, data)`` gives to the chunks under it: weights and weighted values, and how many tiles a chunk awaits.

    ``data`` is the tile's ``size * size`` values row by row; what lies beyond the scene is cut off, a null or NaN weighs nothing. A tile with another number of
    values or a window that the scene lacks is an error.
    """
    weight = _weights(size, overlap)

    def of(scene: int, height: int, width: int, ri: int, ci: int, data: np.ndarray) -> Iterator[tuple]:
        rows, cols = _starts(height, size, size - overlap), _starts(width, size, size - overlap)
        if data.size != size * size or not (0 <= ri < len(rows) and 0 <= ci < len(cols)):
            raise ValueError(f"scene {scene} has no tile {ri}, {ci} of {data.size} values")
        z = data.reshape(size, size)
        ok = np.isfinite(z)
        w = np.where(ok, np.outer(weight, weight), 0.0)
        wz = np.where(ok, z, 0.0) * w
        r0, c0 = int(rows[ri]), int(cols[ci])
        r1, c1 = min(r0 + size, height), min(c0 + size, width)
        for cr in range(r0 // chunk, (r1 - 1) // chunk + 1):
            for cc in range(c0 // chunk, (c1 - 1) // chunk + 1):
                a, b, e, f = cr * chunk, min((cr + 1) * chunk, height), cc * chunk, min((cc + 1) * chunk, width)
                expected = int(((rows < b) & (rows + size > a)).sum() * ((cols < f) & (cols + size > e)).sum())
                top, bottom, left, right = max(r0, a), min(r1, b), max(c0, e), min(c1, f)
                cut = np.s_[top - r0 : bottom - r0, left - c0 : right - c0]
                yield scene, cr, cc, ri << 32 | ci, expected, b - a, f - e, top - a, left - e, bottom - top, right - left, wz[cut].tobytes(), w[cut].tobytes()

    names = [c.split()[0] for c in PART.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                *at, data = (batch.column(k)[i] for k in range(6))
                made = list(of(*(x.as_py() for x in at), data.values.to_numpy(zero_copy_only=False).astype(float)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.binary()])], names=names)

    return tiles.select("scene_id", "height", "width", "ri", "ci", "data").mapInArrow(apply, PART)


class _Stitch(StatefulProcessor):
    """Sums of a chunk and the tiles seen, until all have come; then only that it is done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "wz binary, wt binary, seen array<long>")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        wz = wt = None
        seen: set[int] = set()
        if self.sums.exists():
            a, b, before = self.sums.get()
            wz, wt, seen = np.frombuffer(a).copy(), np.frombuffer(b).copy(), set(before)
        shape, expected = None, None
        for frame in rows:
            for x in frame.itertuples(index=False):
                shape, expected = (x.h, x.w), x.expected
                if wz is None:
                    wz, wt = np.zeros(x.h * x.w), np.zeros(x.h * x.w)
                if x.tile in seen:
                    continue
                seen.add(int(x.tile))
                at = np.s_[x.top : x.top + x.ph, x.left : x.left + x.pw]
                wz.reshape(shape)[at] += np.frombuffer(x.wz).reshape(x.ph, x.pw)
                wt.reshape(shape)[at] += np.frombuffer(x.wt).reshape(x.ph, x.pw)
        if len(seen) < (expected or 0):
            self.sums.update((wz.tobytes(), wt.tobytes(), sorted(seen)))
            return
        self.sums.clear()
        self.done.update((True,))
        z = np.divide(wz, wt, out=np.full(wz.shape, np.nan), where=wt > 0)
        yield pd.DataFrame({"scene_id": [key[0]], "cr": [key[1]], "cc": [key[2]], "height": [shape[0]], "width": [shape[1]], "data": [z]})

    def close(self) -> None:
        pass


def stream_stitch(tiles: DataFrame, size: int, overlap: int, chunk: int = CHUNK) -> DataFrame:
    """``(scene_id, cr, cc, height, width, data)``: chunks of the blended scene, each once, when the last tile over it has come; null where no tile has a value.

    The first copy of a tile counts, later ones are ignored, also after its chunk has left: a chunk that is done keeps one boolean. A chunk without all its tiles
    does not leave. Needs a state store with values by name (RocksDB) in ``spark.sql.streaming.stateStore.providerClass``. Columns beyond those named are dropped.
    """
    return parts(tiles, size, overlap, chunk).groupBy("scene_id", "cr", "cc").transformWithStateInPandas(_Stitch(), OUT, "append", "none")
