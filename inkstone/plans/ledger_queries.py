"""Registered queries on the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import quality, text
from inkstone.operators import ledger
from inkstone.sources import bridge
from inkstone.sources.bridge import JOBS_SQL, LOGS_SQL


def _jobs(f):
    return lambda spark, sf_dir: f(bridge.jobs(spark, sf_dir))


def _logs(f):
    return lambda spark, sf_dir: f(bridge.operation_logs(spark, sf_dir))


def file_policy(jobs):
    """Upload verdict, raster resolution, time limit and title of every job."""
    return jobs.select("id", quality.upload_problem(F.col("original_name"), F.col("file_size"), F.col("pages")).alias("problem"), quality.dpi(F.col("pages")).alias("dpi"), quality.job_timeout(F.col("pages")).alias("timeout"), text.title_of(F.col("original_name")).alias("title"))


def status_board(spark, sf_dir):
    """State of all jobs of the ledger by the audit log."""
    ids = bridge.jobs(spark, sf_dir).select(F.col("id").alias("job_id"))
    return ledger.states_of(ids, bridge.operation_logs(spark, sf_dir))


def messages(spark, sf_dir):
    """Seconds extracted from audit messages that are made of the events' values."""
    logs = bridge.operation_logs(spark, sf_dir)
    made = F.when(F.col("status") == "done", F.concat(F.lit("Time: "), F.round("value").cast("long"), F.lit("s | Pages: 3"))).otherwise("started")
    return ledger.times_in_messages(logs.withColumn("message", made))


QUERIES = {
    "ledger_stats": _jobs(ledger.stats),
    "ledger_history": _jobs(ledger.history),
    "ledger_daily": _jobs(ledger.daily),
    "ledger_failed_window": _jobs(ledger.failed_within),
    "ledger_slow_jobs": _jobs(ledger.slow),
    "ledger_done_times": _jobs(ledger.done_times),
    "ops_by_type": _logs(ledger.operations),
    "ops_recent": _logs(ledger.recent),
    "job_latest_state": _logs(ledger.latest_state),
    "job_status_board": status_board,
    "alert_hourly": _logs(ledger.hourly_alerts),
    "log_time_extract": messages,
    "file_policy": _jobs(file_policy),
}

_J, _L = "WITH " + JOBS_SQL, "WITH " + LOGS_SQL
SQL = {
    "ledger_stats": _J + """
SELECT count(*) AS total_documents, count(*) FILTER (status = 'done') AS successful,
       count(*) FILTER (status <> 'done') AS failed, count(*) FILTER (status = 'processing') AS running,
       round_even(count(*) FILTER (status = 'done') / count(*) * 100, 1) AS success_rate,
       sum(pages)::BIGINT AS total_pages, round_even(sum(file_size)::BIGINT / (1024 * 1024), 2) AS total_size_mb,
       round_even(avg(processing_time_seconds), 1) AS avg_processing_time_seconds,
       count(*) FILTER (created_at::DATE = (SELECT max(created_at)::DATE FROM jobs)) AS documents_today
FROM jobs""",
    "ledger_history": _J + " SELECT * FROM jobs ORDER BY created_at DESC, id DESC LIMIT 100",
    "ledger_daily": _J + """
SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (status = 'done') AS successful,
       round(100.0::DOUBLE * count(*) FILTER (status = 'done') / count(*), 1) AS success_rate,
       sum(pages)::BIGINT AS total_pages, round(avg(processing_time_seconds), 1) AS avg_time
FROM jobs GROUP BY 1""",
    "ledger_failed_window": _J + """
SELECT id, original_name, created_at FROM jobs
WHERE status = 'error' AND created_at > (SELECT max(created_at) FROM jobs) - INTERVAL 24 HOUR""",
    "ledger_slow_jobs": _J + " SELECT id, original_name, processing_time_seconds, pages, created_at FROM jobs WHERE processing_time_seconds > 300",
    "ledger_done_times": _J + """
SELECT avg(processing_time_seconds) AS avg_time, max(processing_time_seconds) AS max_time, min(processing_time_seconds) AS min_time
FROM jobs WHERE status = 'done'""",
    "ops_by_type": _L + " SELECT operation, status, count(*) AS n FROM logs GROUP BY 1, 2",
    "ops_recent": _L + " SELECT * FROM logs ORDER BY timestamp DESC, id DESC LIMIT 20",
    "job_latest_state": _L + """
SELECT job_id, operation, status, id AS log_id, CASE status WHEN 'done' THEN 100 WHEN 'error' THEN 0 ELSE 50 END AS progress
FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, id DESC) = 1""",
    "job_status_board": _J + "," + LOGS_SQL + """,
latest AS (SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, id DESC) = 1)
SELECT j.id AS job_id, coalesce(l.status, 'processing') AS status,
       CASE WHEN l.status IS NULL THEN 5 WHEN l.status = 'done' THEN 100 WHEN l.status = 'error' THEN 0 ELSE 50 END AS progress
FROM jobs j LEFT JOIN latest l ON l.job_id = j.id""",
    "alert_hourly": _L + """
SELECT hour, total, failures, round(ok / total * 100, 1) AS rate,
       CASE WHEN ok / total * 100 < 80 THEN 'critical' WHEN ok / total * 100 < 90 OR failures > 5 THEN 'warning' ELSE 'ok' END AS alert
FROM (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS total, count(*) FILTER (status = 'error') AS failures,
             count(*) FILTER (status <> 'error') AS ok FROM logs GROUP BY 1)""",
    "log_time_extract": _L + " SELECT id, round(value)::BIGINT::DOUBLE AS seconds FROM logs WHERE status = 'done'",
    "file_policy": _J + """
SELECT id, CASE WHEN lower(regexp_extract(original_name, '\\.([^.]+)$', 1)) NOT IN ('pdf','doc','docx','xls','xlsx','ppt','pptx','eml','msg') THEN 'extension'
                WHEN file_size > 200 * 1024 * 1024 THEN 'too_large' WHEN pages > 300 THEN 'too_many_pages' END AS problem,
       CASE WHEN pages <= 30 THEN 150 WHEN pages <= 100 THEN 120 ELSE 100 END AS dpi,
       CASE WHEN pages IS NULL THEN 3600 ELSE greatest(300, least(3600, 300 + 4 * pages)) END AS timeout,
       translate(regexp_replace(original_name, '\\.[^.]*$', ''), '-_', '  ') AS title
FROM jobs""",
}
