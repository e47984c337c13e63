"""Queries on the job ledger and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(jobs: DataFrame, today: Column | None = None) -> DataFrame:
    """One row of totals and rates.  failed counts whatever isn't done, so running jobs too.

    today: the date that documents_today counts; by default that of the newest job.
    """
    day = F.to_date("created_at")
    done = F.count_if(F.col("status") == "done")
    total = F.count(F.lit(1))
    if today is None:
        today = jobs.agg(F.max(day)).scalar()
    return jobs.agg(
        total.alias("total_documents"),
        done.alias("successful"),
        (total - done).alias("failed"),
        F.count_if(F.col("status") == "processing").alias("running"),
        F.when(total > 0, F.bround(done / total * 100, 1)).otherwise(0.0).alias("success_rate"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        F.bround(F.coalesce(F.sum("file_size"), F.lit(0)) / (1024 * 1024), 2).alias("total_size_mb"),
        F.bround(F.coalesce(F.avg("processing_time_seconds"), F.lit(0.0)), 1).alias("avg_processing_time_seconds"),
        F.count_if(day == today).alias("documents_today"),
    )


def history(jobs: DataFrame, n: int = 100) -> DataFrame:
    """The newest jobs; ties by id.  A top-n report: n is the feature."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def daily(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "done")
    return jobs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("total"), done.alias("successful"), F.round(100.0 * done / F.count(F.lit(1)), 1).alias("success_rate"), F.sum("pages").alias("total_pages"), F.round(F.avg("processing_time_seconds"), 1).alias("avg_time")
    )


def failed_within(jobs: DataFrame, hours: int = 24, now: Column | None = None) -> DataFrame:
    """Failed jobs created after now less hours; now is by default the newest creation."""
    if now is None:
        now = jobs.agg(F.max("created_at")).scalar()
    recent = F.col("created_at") > now - F.make_interval(hours=F.lit(hours))
    return jobs.filter((F.col("status") == "error") & recent).select("id", "original_name", "created_at")


def slow(jobs: DataFrame, seconds: float = 300.0) -> DataFrame:
    return jobs.filter(F.col("processing_time_seconds") > seconds).select("id", "original_name", "processing_time_seconds", "pages", "created_at").orderBy(F.desc("processing_time_seconds"), "id")


def done_times(jobs: DataFrame) -> DataFrame:
    t = F.col("processing_time_seconds")
    return jobs.filter("status = 'done'").agg(F.avg(t).alias("avg_time"), F.max(t).alias("max_time"), F.min(t).alias("min_time"))


def operations(logs: DataFrame) -> DataFrame:
    return logs.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"))


def recent(logs: DataFrame, n: int = 20) -> DataFrame:
    """The newest log rows; ties by id.  A top-n report: n is the feature."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def latest_state(logs: DataFrame) -> DataFrame:
    """The last known status of each job with the progress that stands for it."""
    newest = logs.groupBy("job_id").agg(F.max_by(F.struct("operation", "status", "id"), F.struct("timestamp", "id")).alias("last"))
    progress = F.when(F.col("last.status") == "done", 100).when(F.col("last.status") == "error", 0).otherwise(50)
    return newest.select("job_id", F.col("last.operation").alias("operation"), F.col("last.status").alias("status"), F.col("last.id").alias("log_id"), progress.alias("progress"))


def states_of(ids: DataFrame, logs: DataFrame) -> DataFrame:
    """Status of given jobs; one that isn't known is processing at 5."""
    return ids.join(latest_state(logs), "job_id", "left").select("job_id", F.coalesce("status", F.lit("processing")).alias("status"), F.coalesce("progress", F.lit(5)).alias("progress"))


# fixed values: alert thresholds
WARN_RATE, CRITICAL_RATE, MAX_FAILURES = 90.0, 80.0, 5


def hourly_alerts(logs: DataFrame) -> DataFrame:
    """Counts per hour and the alert that they call for."""
    rate = F.col("ok") / F.col("total") * 100
    level = F.when(rate < CRITICAL_RATE, "critical").when((rate < WARN_RATE) | (F.col("failures") > MAX_FAILURES), "warning").otherwise("ok")
    hours = logs.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("failures"), F.count_if(F.col("status") != "error").alias("ok"))
    return hours.select("hour", "total", "failures", F.round(rate, 1).alias("rate"), level.alias("alert"))


def times_in_messages(logs: DataFrame) -> DataFrame:
    """Seconds named in audit messages ("Time: 12.3s")."""
    seconds = F.regexp_extract("message", r"Time: ([0-9]+(?:\.[0-9]+)?)\s*s", 1)
    return logs.select("id", seconds.alias("seconds")).filter("seconds <> ''").select("id", F.col("seconds").cast("double").alias("seconds"))


def report(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored validation report of each id, a stub for those pending, not_found for others."""
    rows = ids.join(jobs.select("id", F.lit(True).alias("known"), "validation_report"), "id", "left")
    stub = F.when(F.col("known").isNull(), "not_found").otherwise("pending")
    return rows.select("id", F.when(F.col("validation_report").isNull(), stub).otherwise("ready").alias("state"), "validation_report")


def delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger without the given ids; ids that aren't there don't matter."""
    return jobs.join(ids.select("id"), "id", "left_anti")


def apply_transitions(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Jobs with status and update time from their latest log row (done or error win)."""
    final = logs.filter(F.col("status").isin("done", "error")).groupBy(F.col("job_id").alias("id")).agg(F.max(F.struct("timestamp", "id", "status")).alias("last"))
    return jobs.join(final, "id", "left").withColumns({"status": F.coalesce("last.status", "status"), "updated_at": F.col("last.timestamp")}).drop("last")


def upsert(jobs: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changes replace rows of the same key; others are added or stay."""
    return jobs.join(changes.select(key), key, "left_anti").unionByName(changes)


