"""Jobs as a fold of their events: batch twins and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rasters import finite
from gridspark.operators.metrics import _sums, from_sums

TERMINAL = ("completed", "failed")


def job_state(events: DataFrame) -> DataFrame:
    """State of each job: the first terminal event locks it, else the latest event counts; attempts are processing events before the lock.

    ``events(job_id, ts, status, event_id)``; equal times are ordered by event_id. Aggregates only: no job's events meet in a list.
    """
    at = F.struct("ts", "event_id")
    ends = F.col("status").isin(*TERMINAL)
    locks = events.groupBy("job_id").agg(F.min(F.when(ends, at)).alias("lock"))
    known = events.join(locks, "job_id").where(F.col("lock").isNull() | (at <= F.col("lock")))
    last = known.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("x"), F.count_if(F.col("status") == "processing").alias("attempts"))
    return last.select("job_id", F.col("x.status").alias("status"), F.col("x.event_id").alias("event_id"), "attempts")


def stale_jobs(state: DataFrame, events: DataFrame, now: str, lease_s: int = 3600, grace_s: int = 60) -> DataFrame:
    """Open jobs whose last sign of life is older than the lease (processing) or the grace (queued)."""
    last = events.groupBy("job_id").agg(F.max("ts").cast("timestamp").alias("seen"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("seen")
    limit = F.when(F.col("status") == "queued", grace_s).otherwise(lease_s)
    return state.where(~F.col("status").isin(*TERMINAL)).join(last, "job_id").where(age > limit).select("job_id", F.lit("JOB_INTERRUPTED").alias("error"))


def active_job(events: DataFrame) -> DataFrame:
    """The job of the latest event of each scene."""
    return events.groupBy("scene_id").agg(F.max(F.struct("ts", "event_id", "job_id", "status")).alias("x")).select("scene_id", "x.job_id", "x.status")


def first_claim(events: DataFrame, status: str = "processing") -> DataFrame:
    """The event that first claimed each job."""
    return events.where(F.col("status") == status).groupBy("job_id").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("job_id", F.col("x.event_id").alias("event_id"))


def stream_pooled_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pooled errors of a stream of pairs, kept as ten sums for each key; pairs that are not finite do not count."""
    ok = pairs.where(finite(F.col("pred")) & finite(F.col("truth")))
    return from_sums(ok.groupBy(*keys).agg(*_sums()), *keys)


def stream_first_claim(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first claim of each job to arrive, exactly once within the watermark."""
    return events.where(F.col("status") == "processing").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id"])


def stage_progress(events: DataFrame) -> DataFrame:
    """Latest status and number of events of each job; in update mode on a stream."""
    return events.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("x"), F.count("*").alias("n_events")).select("job_id", F.col("x.status").alias("status"), "n_events")
