"""Registered job-table queries and the batch twins of the streaming metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as jb
from ..sources.testdata import CALL_LOG_SQL, JOBS_SQL, call_log, jobs, table
from ..streaming import metrics as st
from .registry import register

RESULTS_SQL = "SELECT l_orderkey AS job_id, count(*) AS n_points FROM lineitem GROUP BY l_orderkey"
STATUS_SQL = "CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'running' END"


def _results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return jb.job_results(li.select(F.col("l_orderkey").alias("job_id")))


@register("l1_job_page", dbl=("runtime",), sql=(
    f"SELECT job_id, status, method, created_at, runtime, total, 30 < total AS has_more FROM ("
    f"SELECT job_id, {STATUS_SQL} AS status, method, created_at, runtime FROM ({JOBS_SQL}) _j "
    f"WHERE {STATUS_SQL} = 'completed' AND method = 'umap' AND created_at >= TIMESTAMP '1996-01-01 00:00:00' "
    f"AND created_at <= TIMESTAMP '1999-12-31 00:00:00' ORDER BY created_at DESC, job_id DESC LIMIT 10 OFFSET 20) _p "
    f"CROSS JOIN (SELECT count(*) AS total FROM ({JOBS_SQL}) _j WHERE {STATUS_SQL} = 'completed' AND method = 'umap' "
    f"AND created_at >= TIMESTAMP '1996-01-01 00:00:00' AND created_at <= TIMESTAMP '1999-12-31 00:00:00') _t"))
def q_l1(spark, sf_dir):
    return jb.job_page(jobs(spark, sf_dir), status="completed", method="umap", date_from="1996-01-01",
                       date_to="1999-12-31", offset=20, limit=10)


@register("a26_job_statistics", dbl=("avg_runtime", "success_rate"), sql=(
    "SELECT method, count(*) AS total, count_if(status = 'completed') AS completed, "
    "count_if(status = 'failed') AS failed, count_if(status = 'running') AS running, count_if(status = 'queued') AS queued, "
    "avg(CASE WHEN status = 'completed' THEN runtime END) AS avg_runtime, "
    f"count_if(status = 'completed') / count(*) * 100.0E0 AS success_rate FROM ({JOBS_SQL}) _j GROUP BY ROLLUP (method)"))
def q_a26(spark, sf_dir):
    return jb.job_statistics(jobs(spark, sf_dir))


@register("a27_job_count", sql=(
    f"SELECT count(*) AS count FROM ({JOBS_SQL}) _j WHERE status = 'completed' "
    "AND created_at >= TIMESTAMP '1998-01-01 00:00:00'"))
def q_a27(spark, sf_dir):
    return jb.job_count(jobs(spark, sf_dir), status="completed", date_from="1998-01-01")


@register("k11_backfill_samples", sql=(
    "SELECT count(*) AS jobs, count(processed_samples) AS with_samples_before, "
    "count(coalesce(processed_samples, CAST(json_extract_string(shape, '$[0]') AS INTEGER))) AS with_samples_after, "
    "CAST(sum(coalesce(processed_samples, CAST(json_extract_string(shape, '$[0]') AS INTEGER))) AS BIGINT) "
    f"AS samples_total FROM ({JOBS_SQL}) _j"))
def q_k11(spark, sf_dir):
    return jb.backfill_samples(jobs(spark, sf_dir))


@register("j11_history", sql=(
    f"SELECT job_id, {STATUS_SQL} AS status, method, CAST(coalesce(processed_samples, n_points, 0) AS BIGINT) AS samples "
    f"FROM ({JOBS_SQL}) j LEFT JOIN ({RESULTS_SQL}) r USING (job_id)"))
def q_j11(spark, sf_dir):
    return jb.history(jobs(spark, sf_dir), _results(spark, sf_dir))


LIVE_SQL = "SELECT user_id, arg_max(event_type, ts) AS live_status, max(ts) AS last_update FROM events GROUP BY user_id"


@register("w6_latest_status", sql=LIVE_SQL)
def q_w6(spark, sf_dir):
    return jb.latest_status(table(spark, sf_dir, "events"))


@register("j12_status_overlay", dbl=("progress",), sql=(
    f"SELECT job_id, {STATUS_SQL} AS status, CASE WHEN status = 'completed' THEN 1.0E0 WHEN status = 'failed' "
    "THEN coalesce(progress, 0.0E0) ELSE coalesce(live_progress, progress, 0.0E0) END AS progress, live_status "
    f"FROM ({JOBS_SQL}) j LEFT JOIN (SELECT *, least(live_value / 1000.0E0, 1.0E0) AS live_progress FROM ("
    "SELECT user_id, arg_max(event_type, ts) AS live_status, arg_max(value, ts) AS live_value FROM events GROUP BY user_id) _v) l "
    "ON j.owner_id = l.user_id"))
def q_j12(spark, sf_dir):
    """The latest event of a job's owner stands for its queue entry, its value for the progress."""
    live = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max_by("event_type", "ts").alias("live_status"),
        F.least(F.max_by("value", "ts") / 1000.0, F.lit(1.0)).alias("live_progress"))
    return jb.status_overlay(jobs(spark, sf_dir), live)


@register("e4_available_models", sql=(
    "SELECT job_id, method, created_at, coalesce(CAST(json_extract_string(parameters, '$.n_real') AS BIGINT), n_points) "
    "AS n_real, CAST(json_extract_string(parameters, '$.n_synthetic') AS BIGINT) AS n_synthetic "
    f"FROM ({JOBS_SQL}) j LEFT JOIN ({RESULTS_SQL}) r USING (job_id) WHERE status = 'completed' AND method <> 'pca'"))
def q_e4(spark, sf_dir):
    return jb.available_models(jobs(spark, sf_dir), _results(spark, sf_dir))


@register("l6_l7_display_name", sql=(
    "SELECT job_id, coalesce(upper(method) || ' Embedding - ' || coalesce(json_extract_string(parameters, '$.n_real'), "
    "CAST(processed_samples AS VARCHAR), json_extract_string(shape, '$[0]')) || 'R + ' || "
    "json_extract_string(parameters, '$.n_synthetic') || 'S samples', name) AS display_name, "
    "CASE WHEN runtime IS NULL OR runtime = 0 THEN 'N/A' WHEN runtime < 1 THEN "
    "CAST(CAST(round(runtime * 1000) AS BIGINT) AS VARCHAR) || 'ms' WHEN runtime < 60 THEN CAST(round(runtime, 1) AS VARCHAR) || 's' "
    "ELSE CAST(round(runtime / 60, 1) AS VARCHAR) || 'm' END AS runtime_text FROM (SELECT * REPLACE ("
    "CASE WHEN job_id % 17 = 0 THEN NULL WHEN job_id % 5 = 0 THEN round(runtime / 1.0E6, 4) ELSE runtime END AS runtime) "
    f"FROM ({JOBS_SQL}) _i) _j"))
def q_l6(spark, sf_dir):
    """Runtimes of every unit: some unknown, some below a second."""
    r = F.when(F.col("job_id") % 17 == 0, F.lit(None)).when(F.col("job_id") % 5 == 0, F.round(F.col("runtime") / 1e6, 4))
    return jb.display_name(jobs(spark, sf_dir).withColumn("runtime", r.otherwise(F.col("runtime"))))


@register("k10_partial_update", dbl=("runtime",), sql=(
    "SELECT coalesce(n.job_id, j.job_id) AS job_id, coalesce(n.status, j.status) AS status, j.method, "
    "coalesce(n.runtime, j.runtime) AS runtime FROM (SELECT job_id, status, method, runtime FROM ("
    f"{JOBS_SQL}) _j) j FULL OUTER JOIN (SELECT job_id, 'completed' AS status, CAST(NULL AS DOUBLE) AS runtime "
    f"FROM ({JOBS_SQL}) _r WHERE status = 'running') n ON j.job_id = n.job_id"))
def q_k10(spark, sf_dir):
    t = jobs(spark, sf_dir).select("job_id", "status", "method", "runtime")
    changes = t.where(F.col("status") == "running").select(
        "job_id", F.lit("completed").alias("status"), F.lit(None).cast("double").alias("runtime"))
    return jb.upsert(t, changes)


# ------------------------------------------------------- streaming twins
def _epoch_bucket(width_us: int, k: int = 0) -> str:
    return f"make_timestamp((epoch_us(ts) // {width_us} - {k}) * {width_us})"


def _w1_sql() -> str:
    m = 60_000_000
    ex = " UNION ALL ".join(
        f"SELECT make_timestamp((epoch_us(ts) // {m} - {k}) * {m}) AS window_start, * FROM ({CALL_LOG_SQL}) _c"
        for k in range(5))
    a = ("SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS requests, "
         "avg(response_time) AS mean_response, max(response_time) AS max_response, "
         f"count_if(status_code >= 400) / count(*) AS error_rate FROM ({ex}) _e GROUP BY window_start")
    return (f"SELECT *, CASE WHEN mean_response > 10 THEN 'critical' WHEN mean_response > 5 THEN 'warning' "
            f"ELSE 'healthy' END AS latency_health FROM ({a}) _a")


@register("w1_w3_call_metrics", sql=_w1_sql, dbl=("mean_response", "max_response", "error_rate"))
def q_w1(spark, sf_dir):
    return st.call_metrics_agg(call_log(spark, sf_dir))


@register("w2_hourly_errors", dbl=("error_ratio",), sql=(
    "SELECT window_start, calls, errors, errors / calls AS error_ratio, CASE WHEN errors / calls > 0.1 THEN 'critical' "
    "WHEN errors / calls > 0.05 THEN 'warning' ELSE 'healthy' END AS error_health FROM ("
    f"SELECT {_epoch_bucket(3_600_000_000)} AS window_start, count(*) AS calls, count_if(status_code >= 400) AS errors "
    f"FROM ({CALL_LOG_SQL}) _c GROUP BY 1) _a"))
def q_w2(spark, sf_dir):
    return st.hourly_errors_agg(call_log(spark, sf_dir))


@register("w4_operation_timings", dbl=("mean", "max"), sql=(
    f"SELECT {_epoch_bucket(3_600_000_000)} AS window_start, endpoint AS operation, count(*) AS count, "
    f"avg(response_time) AS mean, max(response_time) AS max FROM ({CALL_LOG_SQL}) _c GROUP BY 1, 2"))
def q_w4(spark, sf_dir):
    return st.operation_timings_agg(call_log(spark, sf_dir))


@register("w5_counters", sql=(
    f"SELECT method, endpoint, count(*) AS calls, count_if(status_code >= 400) AS errors FROM ({CALL_LOG_SQL}) _c "
    "GROUP BY method, endpoint"))
def q_w5(spark, sf_dir):
    return st.counters_agg(call_log(spark, sf_dir))


@register("w7_status_action", sql=(
    f"SELECT status_code, endpoint AS action, count(*) AS requests FROM ({CALL_LOG_SQL}) _c GROUP BY 1, 2"))
def q_w7(spark, sf_dir):
    return st.status_action_agg(call_log(spark, sf_dir))


@register("w6b_terminal_status", sql=(
    "SELECT job_id, coalesce(arg_min(status, ts) FILTER (WHERE status IN ('completed', 'failed')), "
    "arg_max(status, ts)) AS status, max(ts) AS last_update FROM (SELECT user_id AS job_id, CASE "
    "WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END "
    "AS status, ts FROM events) _e GROUP BY job_id"))
def q_w6b(spark, sf_dir):
    """Job status from progress events where a terminal state wins (batch twin of the stateful stream)."""
    from ..streaming import jobstatus as js
    return js.latest_status_batch(js.status_events(table(spark, sf_dir, "events")))


@register("k10b_delete_cascade", sql=(
    f"SELECT (SELECT count(*) FROM ({JOBS_SQL}) _j WHERE status <> 'failed') AS jobs_left, "
    f"(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT job_id FROM ({JOBS_SQL}) _f WHERE status = 'failed')) "
    "AS result_rows_left"))
def q_k10b(spark, sf_dir):
    """Delete the failed jobs and, by cascade, their stored result rows."""
    j = jobs(spark, sf_dir)
    res = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"))
    left_jobs, left_res = jb.delete_cascade(j, res, j.where(F.col("status") == "failed"))
    return left_jobs.agg(F.count("*").alias("jobs_left")).crossJoin(
        left_res.agg(F.count("*").alias("result_rows_left")))


@register("k10c_toggle_favorite_mark_failed", sql=(
    "SELECT status, count_if(fav) AS favorites, count(*) AS jobs FROM (SELECT CASE WHEN status NOT IN "
    "('completed', 'failed') AND created_at < TIMESTAMP '1997-01-01 00:00:00' THEN 'failed' ELSE status END AS status, "
    f"CASE WHEN owner_id % 3 = 0 THEN NOT is_favorite ELSE is_favorite END AS fav FROM ({JOBS_SQL}) _j) _t GROUP BY status"))
def q_k10c(spark, sf_dir):
    """Toggle favourites for a set of jobs, mark stale running jobs failed."""
    j = jobs(spark, sf_dir)
    t = jb.mark_failed(jb.toggle_favorite(j, j.where(F.col("owner_id") % 3 == 0)), "1997-01-01")
    return t.groupBy("status").agg(F.count_if("is_favorite").alias("favorites"), F.count("*").alias("jobs"))
