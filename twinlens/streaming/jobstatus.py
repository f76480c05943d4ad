"""Job status from progress events (W6): a terminal state wins.

Events carry (key, status, ts). Once a job has a terminal event its status is
that of the first such event by event time, else of the latest event. One
aggregation serves a batch and, in update mode, a stream, so a late terminal
event gives the same answer in both. A stream keeps one small row of state a
job; ``drop_after`` bounds how long a finished day's jobs stay in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Event types mapped to job states for the call-log binding.
TERMINAL_OF = {"purchase": "completed", "error": "failed"}
TERMINAL = tuple(TERMINAL_OF.values())


def to_status(col: str = "event_type"):
    c = F.col(col)
    out = F.lit("running")
    for ev, st in TERMINAL_OF.items():
        out = F.when(c == ev, F.lit(st)).otherwise(out)
    return out


def status_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("job_id"), to_status().alias("status"), "ts")


def latest_status_batch(ev: DataFrame, keys: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """First terminal status by time if any, else the latest."""
    term = F.col("status").isin(*TERMINAL)
    a = ev.groupBy(*keys).agg(
        F.min_by(F.when(term, F.col("status")), F.when(term, F.col("ts"))).alias("_first_terminal"),
        F.max_by("status", "ts").alias("_latest"), F.max("ts").alias("last_update"))
    return a.select(*keys, F.coalesce("_first_terminal", "_latest").alias("status"), "last_update")


def latest_status_stream(ev: DataFrame, drop_after: str | None = None) -> DataFrame:
    """Streaming form (update output mode). With ``drop_after`` (a watermark such
    as '7 days') events carry ``day``, the day their job was created, and a job's
    state goes once that day is further behind."""
    if drop_after is None:
        return latest_status_batch(ev)
    return latest_status_batch(ev.withWatermark("day", drop_after), ("job_id", "day"))
