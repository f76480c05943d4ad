"""Structured Streaming metrics against their batch twins, including a late row."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from twinlens.streaming import metrics as st

from .conftest import SF_SMALL


def _calls(spark):
    from twinlens.sources.testdata import call_log
    return call_log(spark, SF_SMALL).select(
        F.col("ts").cast("timestamp").alias("ts"), "endpoint", "status_code", "response_time", "method", "user_id")


def test_stream_matches_batch_and_drops_late_rows(spark):
    calls = _calls(spark).where(F.col("ts") < F.lit("2024-01-02").cast("timestamp"))
    src = tempfile.mkdtemp(prefix="tl-stream-src-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tl-stream-ck-", dir="/tmp")
    calls.coalesce(1).write.mode("overwrite").parquet(f"{src}/batch=0")
    stream = st.read_call_stream(spark, f"{src}/batch=*")
    q = st.start(st.hourly_errors_agg(stream), "tl_hourly", ck, mode="append")
    try:
        q.processAllAvailable()
        # a late row (far behind the watermark) and a row that advances time
        late = spark.createDataFrame(
            [(dt.datetime(2024, 1, 1, 0, 0, 1), "error", 500, 1.0, "GET", 1),
             (dt.datetime(2024, 1, 3, 0, 0, 0), "view", 200, 1.0, "GET", 1)],
            st.CALL_SCHEMA)
        late.coalesce(1).write.mode("overwrite").parquet(f"{src}/batch=1")
        q.processAllAvailable()
        spark.createDataFrame([(dt.datetime(2024, 1, 4, 0, 0, 0), "view", 200, 1.0, "GET", 1)],
                              st.CALL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{src}/batch=2")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.window_start: (r.calls, r.errors) for r in spark.sql("SELECT * FROM tl_hourly").collect()}
    want = {r.window_start: (r.calls, r.errors) for r in st.hourly_errors_agg(calls).collect()}
    for k, v in want.items():
        assert got[k] == v  # the late error row did not change the closed window
    assert dt.datetime(2024, 1, 3, 0, 0) in got


def test_batch_twins_run(spark):
    calls = _calls(spark)
    assert st.call_metrics_agg(calls).count() > 0
    assert st.counters_agg(calls).count() > 0
    assert st.latest_status_agg(calls).count() > 0


def test_terminal_status_stream_matches_batch(spark):
    from twinlens.sources.testdata import table
    from twinlens.streaming import jobstatus as js
    ev = js.status_events(table(spark, SF_SMALL, "events")).select(
        "job_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    src = tempfile.mkdtemp(prefix="tl-js-src-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tl-js-ck-", dir="/tmp")
    cut = F.lit("2024-01-15").cast("timestamp")
    ev.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{src}/part=0")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
    q = (js.latest_status_stream(stream).writeStream.outputMode("update").format("memory")
         .queryName("tl_jobstatus").option("checkpointLocation", ck).start())
    try:
        q.processAllAvailable()
        ev.where(F.col("ts") >= cut).coalesce(1).write.parquet(f"{src}/part=1")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM tl_jobstatus").collect():
        if r.job_id not in got or r.last_update >= got[r.job_id][1]:
            got[r.job_id] = (r.status, r.last_update)
    want = {r.job_id: r.status for r in js.latest_status_batch(ev).collect()}
    assert {k: v[0] for k, v in got.items()} == want


def test_sliding_window_stream_matches_batch(spark):
    calls = _calls(spark).where(F.col("ts") < F.lit("2024-01-03").cast("timestamp"))
    src = tempfile.mkdtemp(prefix="tl-w1-src-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="tl-w1-ck-", dir="/tmp")
    calls.coalesce(1).write.parquet(f"{src}/batch=0")
    q = st.start(st.call_metrics_agg(st.read_call_stream(spark, f"{src}/batch=*")), "tl_w1", ck, mode="append")
    try:
        q.processAllAvailable()
        # advance event time past the watermark so every window above closes
        spark.createDataFrame([(dt.datetime(2024, 1, 5), "view", 200, 1.0, "GET", 1)],
                              st.CALL_SCHEMA).coalesce(1).write.parquet(f"{src}/batch=1")
        q.processAllAvailable()
        spark.createDataFrame([(dt.datetime(2024, 1, 6), "view", 200, 1.0, "GET", 1)],
                              st.CALL_SCHEMA).coalesce(1).write.parquet(f"{src}/batch=2")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.window_start: (r.requests, round(r.mean_response, 9)) for r in spark.sql("SELECT * FROM tl_w1").collect()}
    want = {r.window_start: (r.requests, round(r.mean_response, 9)) for r in st.call_metrics_agg(calls).collect()}
    assert want and all(got.get(k) == v for k, v in want.items())
