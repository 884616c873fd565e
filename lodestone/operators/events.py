"""Events as tables: windows over event time, and the state that a sequence of events leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _windowed(events: DataFrame, window) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def tumbling_windows(events: DataFrame, length: str) -> DataFrame:
    """(window_start, event_type, n, total) for tables and streams; a stream needs a watermark on ts."""
    return _windowed(events, F.window("ts", length))


def sliding_windows(events: DataFrame, length: str, step: str) -> DataFrame:
    return _windowed(events, F.window("ts", length, step))


def session_windows(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, session_start, session_end, n): a session ends once nothing came for `gap`, which counts into it."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def workflow_state(states: DataFrame) -> DataFrame:
    """(workflow_id, status, rag_stage, rag_progress, states, furthest): what the latest state says; one aggregate, so a busy workflow is no hot group."""
    last = F.max_by(F.struct("status", "rag_stage", "rag_progress"), F.struct("state_time", "state_no"))
    return states.groupBy("workflow_id").agg(last.alias("x"), F.count("*").alias("states"), F.max("rag_progress").alias("furthest")).select("workflow_id", "x.*", "states", "furthest")
