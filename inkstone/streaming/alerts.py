"""Alerts over the operation log as a stream.  An addition: the log is otherwise only polled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.operators.ledger import CRITICAL_RATE, MAX_FAILURES, WARN_RATE


def hourly_alerts(logs: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and alert per tumbling window; rows later than the watermark are dropped."""
    failed = F.count_if(F.col("status") == "error")
    logs = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))  # watermarks need instants
    counts = logs.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w")).agg(F.count(F.lit(1)).alias("total"), failed.alias("failures"))
    rate = (F.col("total") - F.col("failures")) / F.col("total") * 100
    level = F.when(rate < CRITICAL_RATE, "critical").when((rate < WARN_RATE) | (F.col("failures") > MAX_FAILURES), "warning").otherwise("ok")
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "total", "failures", F.round(rate, 1).alias("rate"), level.alias("alert"))


def job_progress(logs: DataFrame) -> DataFrame:
    """The latest status of each job, for an update-mode sink; one row of state per job."""
    last = logs.groupBy("job_id").agg(F.max(F.struct("timestamp", "id", "operation", "status")).alias("last"))
    return last.select("job_id", "last.operation", "last.status", "last.timestamp")
