"""Stitching of a stream against the batch form: tiles out of order, repeated, late, and over a restart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import tiling
from gridspark.streaming import stitching

STORE = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "scene_id long, height int, width int, ri int, ci int, data array<double>"
SIZE, OVERLAP, CHUNK = 16, 4, 10


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def made_tiles():
    """Tiles of a scene of 37 x 50 and of one smaller than a tile; values differ between tiles, some are missing."""
    rnd = np.random.default_rng(4)
    rows = []
    for scene, h, w in [(1, 37, 50), (2, 9, 12)]:
        for ri in range(len(stitching._starts(h, SIZE, SIZE - OVERLAP))):
            for ci in range(len(stitching._starts(w, SIZE, SIZE - OVERLAP))):
                z = rnd.normal(0, 1, SIZE * SIZE)
                z[rnd.random(SIZE * SIZE) < 0.05] = np.nan
                rows.append((scene, h, w, ri, ci, z.tolist()))
    return rows


def pixels_of(chunks):
    out = {}
    for x in chunks:
        for i, v in enumerate(x.data):
            at = (x.scene_id, x.cr * CHUNK + i // x.width, x.cc * CHUNK + i % x.width)
            assert at not in out
            out[at] = "nan" if v is None else round(v, 9)
    return out


def expected(spark, rows):
    stride = SIZE - OVERLAP
    flat = []
    for scene, h, w, ri, ci, data in rows:
        r0, c0 = int(stitching._starts(h, SIZE, stride)[ri]), int(stitching._starts(w, SIZE, stride)[ci])
        flat += [(scene, r0 + i // SIZE, c0 + i % SIZE, i // SIZE, i % SIZE, v) for i, v in enumerate(data) if r0 + i // SIZE < h and c0 + i % SIZE < w]
    whole = tiling.stitch(spark.createDataFrame(flat, "scene_id long, row int, col int, i int, j int, z double"), SIZE, OVERLAP)
    return {(r.scene_id, r.row, r.col): "nan" if np.isnan(r.z) else round(r.z, 9) for r in whole.collect()}


def test_stream(spark, rocks, tmp_path):
    rows = made_tiles()
    order = rows[:]
    random.Random(1).shuffle(order)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [order[:6], order[6:10] + order[:3], order[10:], order[2:8]]  # repeated while open and after all has left
    seen = []
    for batch in batches:  # each start goes on from the state of the one before
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stitching.stream_stitch(spark.readStream.schema(SCHEMA).parquet(source), SIZE, OVERLAP, CHUNK)
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
        run.awaitTermination(300)
        assert run.exception() is None
        seen.append(spark.read.schema(stitching.OUT).parquet(sink).count())
    assert seen[0] < seen[2] == seen[3]
    assert pixels_of(spark.read.parquet(sink).collect()) == expected(spark, rows)


def test_unknown_tile(spark, rocks):
    with pytest.raises(Exception, match="has no tile"):
        stitching.parts(spark.createDataFrame([(1, 20, 20, 5, 0, [0.0] * 256)], SCHEMA), SIZE, OVERLAP).agg(F.count("*")).collect()
