"""Tool telemetry: totals, errors, and the last calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls kept in the ring.
RING = 50


def by_tool(calls: DataFrame) -> DataFrame:
    """(tool, calls, errors, first_at, last_at, total_ms) of calls (tool, project_id, ok, duration_ms, at)."""
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.min("at").alias("first_at"),
        F.max("at").alias("last_at"), F.sum("duration_ms").alias("total_ms"))


def ring(calls: DataFrame, most: int = RING) -> DataFrame:
    """The last calls, newest last; equal times by call_id."""
    return calls.orderBy(F.desc("at"), F.desc("call_id")).limit(most).orderBy("at", "call_id")


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(~F.col("ok")).alias("errors"),
                     F.countDistinct("tool").alias("tools"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def latest_state(jobs: DataFrame) -> DataFrame:
    """(project_id, state): each project's latest job state; a cancelled one failed."""
    state = F.when(F.col("state") == "cancelled", "failed").otherwise(F.col("state"))
    return jobs.groupBy("project_id").agg(F.max_by(state, F.struct("at", "state")).alias("state"))


def sync_guidance(state, has_index, elapsed_s):
    """One sentence on what to do, from a job's state and whether there is an index."""
    return (F.when(state == "running", F.concat(F.lit("Sync running for "), elapsed_s.cast("string"), F.lit(" s; call again later.")))
            .when(state == "failed", F.lit("The last sync failed; start it again."))
            .when(has_index, F.lit("The index is ready.")).otherwise(F.lit("No index yet; start a sync.")))


def from_events(events: DataFrame) -> DataFrame:
    """Calls from the events table."""
    return events.select(
        F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), F.col("user_id").alias("project_id"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_ms"), F.col("ts").alias("at"))
