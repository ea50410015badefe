"""Job state as a fold over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Progress in per cent at the start of each stage.
PROGRESS = {"queued": 0, "preprocessing": 5, "segmentation": 10, "feature_extraction": 35, "matching": 55, "adjacency_refinement": 70, "sequencing": 78, "rendering": 85, "done": 100, "failed": 0}
ORDER = ("ts", "seq")


def status_of(stage: Column) -> Column:
    return F.when(stage == "queued", "pending").when(stage == "done", "done").when(stage == "failed", "failed").otherwise("running")


def stage_progress(stage: Column) -> Column:
    out = None
    for name, p in PROGRESS.items():
        out = F.when(stage == name, p) if out is None else out.when(stage == name, p)
    return out.cast("long")


def _last(col: str) -> Column:
    """The value of the latest event in which it is not null: combines before the shuffle, unlike a window."""
    key = F.struct(*ORDER)
    return F.max(F.when(F.col(col).isNotNull(), F.struct(key.alias("k"), F.col(col).alias("v"))))["v"]


def latest(events: DataFrame) -> DataFrame:
    """job_id, stage, progress, error, updated_at: partial updates, in which null leaves a field as it was."""
    return events.groupBy("job_id").agg(_last("stage").alias("stage"), _last("progress").alias("progress"), _last("error").alias("error"), F.max("ts").alias("updated_at"))


def timeline(events: DataFrame) -> DataFrame:
    """Every event with the job's status and progress after it: a stage sets its own progress, a failure leaves it, and
    a reported number wins."""
    w = Window.partitionBy("job_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = F.coalesce("progress", F.when(F.col("stage") != "failed", stage_progress(F.col("stage"))))
    out = events.withColumn("told", told).withColumn("progress", F.coalesce(F.last("told", ignorenulls=True).over(w), F.lit(0).cast("long")))
    return out.withColumn("status", status_of(F.col("stage"))).drop("told")


def expiry(events: DataFrame, hours: int = 24) -> DataFrame:
    """job_id, expiry_gaps (pauses longer than the time to live), alive_at_end (at the log's last event)."""
    w = Window.partitionBy("job_id").orderBy(*ORDER)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = events.withColumn("us", us).withColumn("gap", F.col("us") - F.lag("us").over(w))
    limit = hours * 3600 * 1_000_000
    end = events.agg(F.max(us).alias("end"))
    per = gaps.groupBy("job_id").agg(F.sum((F.coalesce("gap", F.lit(0)) > limit).cast("long")).alias("expiry_gaps"), F.max("us").alias("last"))
    return per.join(F.broadcast(end)).select("job_id", "expiry_gaps", (F.col("end") - F.col("last") <= limit).alias("alive_at_end"))


def correctable(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests (job_id) with the error that refuses them: job_not_found, or conflict unless the job is done."""
    out = requests.join(state.select("job_id", "stage"), "job_id", "left")
    return out.withColumn("error", F.when(F.col("stage").isNull(), "job_not_found").when(F.col("stage") != "done", "conflict")).drop("stage")
