"""Reports over background jobs and their items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.params import JOB_UNFINISHED


def _micros(moment: Column | datetime) -> Column:
    value = moment if isinstance(moment, Column) else F.lit(moment)
    return F.unix_micros(value.cast("timestamp"))


def job_progress(items: DataFrame) -> DataFrame:
    """Completed and failed item counts per job."""
    return items.groupBy("job_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed_items"),
        F.count_if(F.col("status") == "FAILED").alias("failed_items"),
    )


def job_outcome(progress: DataFrame) -> DataFrame:
    """Final status and error text of each job."""
    failed = F.col("failed_items") > 0
    return progress.select(
        "job_id",
        F.when(failed, F.lit("FAILED")).otherwise(F.lit("COMPLETED")).alias("status"),
        F.when(failed, F.concat(F.col("failed_items").cast("string"), F.lit(" background item(s) failed"))).alias("error"),
    )


def job_progress_ratio(jobs: DataFrame) -> DataFrame:
    """Handled share in percent, at most 100; 0 for a job without items."""
    handled = F.col("completed_items") + F.col("failed_items")
    percent = F.least(F.lit(100.0), handled / F.nullif(F.col("total_items"), F.lit(0)) * 100)
    return jobs.select("job_id", F.coalesce(percent, F.lit(0.0)).alias("percent"))


def elapsed_seconds(now: datetime | Column) -> Column:
    """Active seconds of a job row: up to its end, its pause or `now`, minus paused seconds."""
    paused = F.when(F.col("control_state") == "PAUSED", F.col("paused_at"))
    end = F.coalesce(_micros(F.col("finished_at")), _micros(paused), _micros(now))
    active = (end - _micros(F.col("started_at"))) / F.lit(1e6) - F.col("paused_seconds")
    return F.when(F.col("started_at").isNull(), F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.bround(active, 0).cast("long"))
    ).cast("long")


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def current_job(jobs: DataFrame) -> DataFrame:
    """The latest unfinished job that is not stopped; at most one row."""
    live = jobs.filter(F.col("status").isin(*JOB_UNFINISHED) & (F.col("control_state") != "STOPPED"))
    return job_list(live).limit(1)


def stale_leases(jobs: DataFrame, now: datetime | Column, timeout_seconds: int) -> DataFrame:
    """Running, active jobs without a heartbeat since `now` minus the timeout."""
    cutoff = _micros(now) - timeout_seconds * 1_000_000
    return jobs.filter(
        (F.col("status") == "RUNNING")
        & (F.col("control_state") == "ACTIVE")
        & (F.col("heartbeat_at").isNull() | (_micros(F.col("heartbeat_at")) < cutoff))
    )
