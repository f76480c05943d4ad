"""Call-log metrics as Structured Streaming queries and their batch twins
(W1-W7).

Event time is ``ts``; late rows older than the watermark (10 minutes, our
choice: the source keeps no rule) are dropped by the streaming aggregation.
Each ``*_agg`` function takes a batch or a streaming DataFrame, so the batch
twin and the stream run the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

WATERMARK = "10 minutes"

CALL_SCHEMA = StructType([
    StructField("ts", TimestampType()), StructField("endpoint", StringType()),
    StructField("status_code", IntegerType()), StructField("response_time", DoubleType()),
    StructField("method", StringType()), StructField("user_id", LongType())])


def _err():
    return F.col("status_code") >= 400


def _windowed(df: DataFrame, duration: str, slide: str | None = None, *keys: str):
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    if df.isStreaming:
        df = df.withWatermark("ts", WATERMARK)
    return df.groupBy(w.alias("w"), *keys)


def call_metrics_agg(df: DataFrame) -> DataFrame:
    """W1 (+W3): 5-minute windows sliding by 1 minute: requests, mean and max
    response time, error rate, latency health."""
    a = _windowed(df, "5 minutes", "1 minute").agg(
        F.count("*").alias("requests"), F.avg("response_time").alias("mean_response"),
        F.max("response_time").alias("max_response"),
        (F.count_if(_err()) / F.count("*")).alias("error_rate"))
    health = (F.when(F.col("mean_response") > 10, "critical").when(F.col("mean_response") > 5, "warning")
               .otherwise("healthy"))
    return a.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", "mean_response", "max_response", "error_rate", health.alias("latency_health"))


def hourly_errors_agg(df: DataFrame) -> DataFrame:
    """Hourly calls and errors; error ratio > 0.1 critical, > 0.05 warning."""
    a = _windowed(df, "1 hour").agg(F.count("*").alias("calls"), F.count_if(_err()).alias("errors"))
    ratio = F.col("errors") / F.col("calls")
    return a.select(F.col("w.start").alias("window_start"), "calls", "errors", ratio.alias("error_ratio"),
                    F.when(ratio > 0.1, "critical").when(ratio > 0.05, "warning").otherwise("healthy")
                     .alias("error_health"))


def operation_timings_agg(df: DataFrame) -> DataFrame:
    """Per hour and operation: count, mean and max duration."""
    a = _windowed(df, "1 hour", None, "endpoint").agg(
        F.count("*").alias("count"), F.avg("response_time").alias("mean"), F.max("response_time").alias("max"))
    return a.select(F.col("w.start").alias("window_start"), F.col("endpoint").alias("operation"),
                    "count", "mean", "max")


def counters_agg(df: DataFrame) -> DataFrame:
    """Running counters per method and endpoint (update mode when streaming)."""
    return df.groupBy("method", "endpoint").agg(F.count("*").alias("calls"),
                                                F.count_if(_err()).alias("errors"))


def status_action_agg(df: DataFrame) -> DataFrame:
    """Requests grouped by status and action."""
    return df.groupBy("status_code", F.col("endpoint").alias("action")).agg(F.count("*").alias("requests"))


def latest_status_agg(df: DataFrame) -> DataFrame:
    """Latest event per user by event time (terminal states are just the
    latest here)."""
    return df.groupBy("user_id").agg(F.max_by("endpoint", "ts").alias("live_status"),
                                     F.max("ts").alias("last_update"))


def read_call_stream(spark: SparkSession, directory: str, max_files: int = 1) -> DataFrame:
    """A file-source stream of call-log parquet files with a fixed schema."""
    return (spark.readStream.schema(CALL_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(directory))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory"):
    """Start a streaming aggregation; ``sink='memory'`` exposes table ``name``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink).option("path", name)
    return w.start()
