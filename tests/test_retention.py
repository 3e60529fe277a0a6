"""Jobs and their figures: the oldest ended ones against sorting, pooled errors without values that are not finite."""

import datetime
import random

from pyspark.sql import functions as F

from gridspark.operators.listings import job_retention
from gridspark.streaming.jobs import stream_pooled_metrics


def test_retention_equals_sorting(spark):
    rng = random.Random(3)
    now = datetime.datetime(2024, 5, 10)
    at = [now - datetime.timedelta(seconds=rng.choice([5, 6, 7, 90_000, 90_001, 200_000]) + rng.choice([0, 0.25, 0.5])) for _ in range(120)]
    rows = [(i, t, rng.choice(["completed", "failed", "queued"])) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "job_id long, created timestamp, status string")
    for keep, hours in ((0, 1000), (20, 1000), (50, 25), (118, 1000), (500, 1)):
        got = {(r.job_id, r.why) for r in job_retention(df, F.lit(now), hours, keep).collect()}
        # whole seconds apart, as timestamp_diff counts them
        old = {i for i, t, _ in rows if int((now - t).total_seconds()) > hours * 3600}
        ended = sorted((t, i) for i, t, s in rows if i not in old and s != "queued")
        over = max(0, len(rows) - len(old) - keep)
        assert got == {(i, "expired") for i in old} | {(i, "overflow") for _, i in ended[:over]}, (keep, hours)


def test_pooled_errors_skip_what_is_not_finite(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 1.0), ("a", float("nan"), 1.0), ("a", 2.0, float("inf")), ("a", None, 1.0), ("b", float("nan"), 1.0)]
    got = {r["split"]: r for r in stream_pooled_metrics(spark.createDataFrame(rows, "split string, pred double, truth double"), "split").collect()}
    assert got.keys() == {"a"} and got["a"].n == 2 and got["a"].mae == 1.5
