"""Focal and fitting operators against plain numpy."""

import numpy as np

from gridspark.operators import focal, metrics
from gridspark.streaming import jobs


def test_slope_equals_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(7, 9))
    df = spark.createDataFrame([(0, i, j, float(z[i, j])) for i in range(7) for j in range(9)], "scene_id long, row int, col int, z double")
    got = np.zeros_like(z)
    for r in focal.slope_deg(df, 0.5).collect():
        got[r["row"], r["col"]] = r["slope"]
    gy, gx = np.gradient(z, 0.5)
    assert np.allclose(got, np.degrees(np.arctan(np.hypot(gy, gx))))


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 100, 300)
    y = 0.4 * x - 3 + rng.normal(scale=0.2, size=300)
    y[:15] += 500
    a, b = metrics.fit_affine_huber(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "pred double, truth double"))
    assert abs(a - 0.4) < 0.01 and abs(b + 3) < 0.6


def test_stream_equals_batch(spark, tmp_path):
    rows = [("train", float(i), float(i % 7)) for i in range(200)] + [("val", float(i), 2.0 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "split string, pred double, truth double")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = jobs.stream_pooled_metrics(stream, "split").writeStream.outputMode("complete").format("memory").queryName("pooled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    want = {r["split"]: round(r["rmse"], 9) for r in metrics.pooled_metrics(df, "split").collect()}
    assert {r["split"]: round(r["rmse"], 9) for r in spark.table("pooled").collect()} == want
