"""Formulas against values worked out by hand from their definition, not from the operators."""

import hashlib

from pyspark.sql import functions as F

from gridspark.operators import components, damage, georef, listings


def test_crop_is_clipped_before_it_is_widened(spark):
    # side of 10 padded by 16: in the open 34 to 76, 42 long, widened by (64 - 42) // 2 + 1; at the border 0 to 26, widened by 20 but not below 0
    box = spark.createDataFrame([(50, 0, 60, 10), (0, 120, 200, 200)], "r0 int, c0 int, r1 int, c1 int")
    crop = damage.crop_context(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"), 1000, 190)
    got = box.select(*(v.alias(k) for k, v in crop.items())).collect()
    assert [tuple(r) for r in got] == [(22, 88, 0, 46), (0, 250, 100, 190)]  # (row0, row1, col0, col1)


def test_footprint_key(spark):
    row = spark.createDataFrame([(-1.5, 2.0, 3.25, 4.0, None), (-1.5, 2.0, 3.25, 4.0, "EPSG:32632")], "w double, s double, e double, n double, crs string")
    got = [r.k for r in row.select(georef.footprint_key(*(F.col(c) for c in ("w", "s", "e", "n", "crs"))).alias("k")).collect()]
    assert got == [hashlib.sha256(f"-1.500000,2.000000,3.250000,4.000000,{c}".encode()).hexdigest()[:8] for c in ("None", "EPSG:32632")]


def test_object_height(spark):
    label = "scene_id long, row int, col int, label_row int, label_col int"
    # eleven values with two far off; the ring's 20th percentile of 1..6 is 2. A second object is flat, without a ring
    z = [10.0, 10.0, 10.5, 11.0, 11.0, 11.0, 11.5, 12.0, 12.0, 40.0, -30.0]
    labels = spark.createDataFrame([(0, 0, k, 0, 0) for k in range(11)] + [(0, 5, k, 5, 0) for k in range(3)], label)
    ring = spark.createDataFrame([(0, 1, k, 0, 0) for k in range(6)], label)
    px = spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(z)] + [(0, 1, k, k + 1.0) for k in range(6)] + [(0, 5, k, 7.0) for k in range(3)], "scene_id long, row int, col int, z double")
    a, b = sorted(components.object_height(labels, px, ring).collect(), key=lambda r: r.label_row)
    assert (a.n, a.base, a.height, a.median, a.p10, a.p90) == (11, 2.0, 9.0, 9.0, 8.0, 10.0) and abs(a.mad - 1.4826) < 1e-9
    assert (b.n, b.base, b.height, b.median, b.mad, b.p10, b.p90) == (3, 0.0, 7.0, 7.0, 0.0, 7.0, 7.0)


def test_objects_end_before_their_last_row_and_column(spark):
    cells = [(0, r, c) for r in range(2, 7) for c in range(3, 8)] + [(0, 20, c) for c in range(24)]  # 25 and 24 pixels
    labels = components.label_components(spark.createDataFrame(cells, "scene_id long, row int, col int"), 4, 8)
    (one,) = components.extract_objects(labels, labels.withColumn("conf", F.col("col") / 10)).collect()
    assert (one.object_id, one.area, one.row0, one.row1, one.col0, one.col1, one.cy, one.cx, one.max_conf) == ("B001", 25, 2, 7, 3, 8, 4.0, 5.0, 0.7)


def test_reference_raster(spark):
    files = {
        1: [("scene.tif", True), ("x-truth.tif", False), ("ref_dem.tif", False)],
        2: [("a_gt.TIFF", False), ("vgt.tif", False), ("truth.png", False)],
        3: [("a_gt.tif", False), ("ground_truth.tif", False)],
        4: [("reference.tif", True), ("my_reference_v2.tif", None)],
        5: [("image.tif", True)],
    }
    df = spark.createDataFrame([(s, n, i) for s, f in files.items() for n, i in f], "scene_id long, name string, is_input boolean")
    got = {r.scene_id: (r.reference, r.ambiguous) for r in listings.pick_reference(df).collect()}
    assert got == {1: ("ref_dem.tif", False), 2: ("a_gt.TIFF", False), 3: (None, True), 4: ("my_reference_v2.tif", False), 5: (None, False)}
