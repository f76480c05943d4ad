"""Job table operators.

The job table is an ordinary DataFrame; mutations are copy-on-write
(anti-join + union) so they can be written back with dynamic partition
overwrite instead of row-level updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def _ts(text: str):
    """A wall-clock timestamp literal (NTZ), so filters do not depend on the
    session time zone."""
    return F.lit(text).cast("timestamp_ntz")


def display_status(col: str = "status"):
    """L2: completed / failed kept, anything else shown as running."""
    return F.when(F.col(col).isin(*TERMINAL), F.col(col)).otherwise(F.lit("running"))


def job_page(jobs: DataFrame, status: str | None = None, method: str | None = None,
             date_from: str | None = None, date_to: str | None = None, favorites_only: bool = False,
             offset: int = 0, limit: int = 20) -> DataFrame:
    """L1: filtered (before paging), newest first, with total and has_more."""
    f = jobs
    if status:
        f = f.where(display_status() == status)
    if method:
        f = f.where(F.col("method") == method)
    if date_from:
        f = f.where(F.col("created_at") >= _ts(date_from))
    if date_to:
        f = f.where(F.col("created_at") <= _ts(date_to))
    if favorites_only:
        f = f.where("is_favorite")
    total = f.agg(F.count("*").alias("total"))
    # sort + offset + limit plans as a per-partition top-(offset + limit)
    page = (f.select("job_id", display_status().alias("status"), "method", "created_at", "runtime")
             .orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(offset).limit(limit))
    return page.crossJoin(total).select(
        "job_id", "status", "method", "created_at", "runtime", "total",
        (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def job_statistics(jobs: DataFrame) -> DataFrame:
    """A26 with ``rollup``: per method and overall (method null); the success
    rate is in percent."""
    return jobs.rollup("method").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.avg(F.when(F.col("status") == "completed", F.col("runtime"))).alias("avg_runtime"),
        (F.count_if(F.col("status") == "completed") / F.count("*") * 100.0).alias("success_rate"))


def job_count(jobs: DataFrame, status: str | None = None, date_from: str | None = None) -> DataFrame:
    """A27."""
    f = jobs
    if status:
        f = f.where(F.col("status") == status)
    if date_from:
        f = f.where(F.col("created_at") >= _ts(date_from))
    return f.agg(F.count("*").alias("count"))


def backfill_samples(jobs: DataFrame) -> DataFrame:
    """Fill processed_samples from the JSON shape where null; report
    null-aware counts before and after."""
    filled = F.coalesce(F.col("processed_samples"),
                        F.get_json_object("shape", "$[0]").cast("int"))
    return jobs.agg(F.count("*").alias("jobs"),
                    F.count("processed_samples").alias("with_samples_before"),
                    F.count(filled).alias("with_samples_after"),
                    F.sum(filled).cast("long").alias("samples_total"))


def job_results(points: DataFrame) -> DataFrame:
    """Stored results per job: number of embedded points."""
    return points.groupBy("job_id").agg(F.count("*").alias("n_points"))


def history(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Job list left-joined with results; sample count from the job,
    else from its results, else 0."""
    j = jobs.join(results, "job_id", "left")
    return j.select("job_id", display_status().alias("status"), "method",
                    F.coalesce("processed_samples", "n_points", F.lit(0)).cast("long").alias("samples"))


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """W6 (batch): latest event per key by time."""
    return events.groupBy(key).agg(F.max_by("event_type", "ts").alias("live_status"),
                                   F.max("ts").alias("last_update"))


def status_overlay(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """A stored terminal status wins; else running. Progress is 1.0 when
    completed, the stored one (or 0) when failed, and the live one before the
    stored one while running."""
    j = jobs.join(live, jobs["owner_id"] == live["user_id"], "left")
    st, stored = display_status(), F.coalesce("progress", F.lit(0.0))
    return j.select("job_id", st.alias("status"),
                    F.when(st == "completed", F.lit(1.0)).when(st == "failed", stored)
                     .otherwise(F.coalesce("live_progress", stored)).alias("progress"),
                    "live_status")


def available_models(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Completed jobs that kept a model, sample counts from parameters
    else results, newest first."""
    j = jobs.where((F.col("status") == "completed") & (F.col("method") != "pca")).join(results, "job_id", "left")
    n_real = F.coalesce(F.get_json_object("parameters", "$.n_real").cast("long"), F.col("n_points"))
    return (j.select("job_id", "method", "created_at", n_real.alias("n_real"),
                     F.get_json_object("parameters", "$.n_synthetic").cast("long").alias("n_synthetic"))
             .orderBy(F.col("created_at").desc(), F.col("job_id").desc()))


def display_name(jobs: DataFrame) -> DataFrame:
    """L6 + L7: job name from the sample counts of both sides (parameters, else
    processed samples, else shape; the stored name when a side has none) and the
    runtime as text (ms, s, m; N/A when unknown or zero)."""
    param = lambda key: F.get_json_object("parameters", f"$.{key}")
    n_real = F.coalesce(param("n_real"), F.col("processed_samples").cast("string"), F.get_json_object("shape", "$[0]"))
    n_syn = param("n_synthetic")
    name = F.coalesce(F.concat(F.upper("method"), F.lit(" Embedding - "), n_real, F.lit("R + "), n_syn, F.lit("S samples")),
                      F.col("name"))
    r = F.col("runtime")
    txt = (F.when(r.isNull() | (r == 0), F.lit("N/A"))
            .when(r < 1, F.concat(F.round(r * 1000).cast("long").cast("string"), F.lit("ms")))
            .when(r < 60, F.concat(F.round(r, 1).cast("string"), F.lit("s")))
            .otherwise(F.concat(F.round(r / 60, 1).cast("string"), F.lit("m"))))
    return jobs.select("job_id", name.alias("display_name"), txt.alias("runtime_text"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """K10 partial update: non-null fields of ``changes`` win, others keep
    the stored value; unseen keys are inserted (copy-on-write)."""
    cols = table.columns
    c = changes.select(*[F.col(x).alias(f"_n_{x}") if x in changes.columns else F.lit(None).alias(f"_n_{x}")
                         for x in cols])
    j = table.join(c, table[key] == c[f"_n_{key}"], "full_outer")
    return j.select(*[F.coalesce(F.col(f"_n_{x}"), F.col(x)).alias(x) for x in cols])


def delete_jobs(table: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    """K10 delete: anti-join (cascades the same way on results)."""
    return table.join(keys.select(key), key, "left_anti")


def toggle_favorite(table: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    """Flip ``is_favorite`` for the given jobs (left join on a key set)."""
    k = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    j = table.join(k, key, "left")
    return j.select(*[(F.when(F.col("_hit"), ~F.col("is_favorite")).otherwise(F.col("is_favorite"))
                       .alias("is_favorite") if c == "is_favorite" else F.col(c)) for c in table.columns])


def mark_failed(table: DataFrame, before: str) -> DataFrame:
    """Jobs still running that were created before ``before`` become failed."""
    stale = ~F.col("status").isin(*TERMINAL) & (F.col("created_at") < _ts(before))
    return table.select(*[(F.when(stale, F.lit("failed")).otherwise(F.col("status")).alias("status")
                           if c == "status" else F.col(c)) for c in table.columns])


def delete_cascade(table: DataFrame, results: DataFrame, keys: DataFrame, key: str = "job_id"):
    """Delete jobs and their stored results (two anti-joins)."""
    return delete_jobs(table, keys, key), results.join(keys.select(key), key, "left_anti")
