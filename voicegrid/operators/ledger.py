"""Run ledger: an append-only event table and the state folded from it.

Event columns: run_id, event_seq (bigint, order of the run's events), event_time,
kind ('create' or 'update'), app_name, app_id, status, step, payload
(map<string,string>), error.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "run_id string, event_seq bigint, event_time timestamp, kind string, app_name string, app_id string, "
    "status string, step string, payload map<string,string>, error string"
)


def created(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """First event of a new run per request (app_name, app_id)."""
    return requests.select(
        F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")).alias("run_id"),
        F.lit(0).cast("bigint").alias("event_seq"),
        (F.current_timestamp() if now is None else now).alias("event_time"),
        F.lit("create").alias("kind"),
        "app_name",
        "app_id",
        F.lit("running").alias("status"),
        F.lit("created").alias("step"),
        F.create_map().cast("map<string,string>").alias("payload"),
        F.lit(None).cast("string").alias("error"),
    )


class Recorder:
    """Appends the events of one run to a folder of event files; without a folder it does nothing."""

    def __init__(self, spark: SparkSession, folder: str | None, run_id: str):
        self.spark, self.folder, self.run_id, self.number = spark, folder, run_id, 0

    def _append(self, kind: str, app_name=None, app_id=None, status=None, step=None, payload=None, error=None) -> None:
        if self.folder is None:
            return
        now = datetime.datetime.now(datetime.timezone.utc)
        row = (self.run_id, self.number, now, kind, app_name, app_id, status, step, payload or {}, error)
        self.spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        self.number += 1

    def create(self, app_name: str | None = None, app_id: str | None = None) -> None:
        self._append("create", app_name, app_id, "running", "created")

    def step(self, name: str, status: str | None = None, payload: dict[str, str] | None = None) -> None:
        self._append("update", status=status, step=name, payload=payload)

    def fail(self, error: Exception) -> None:
        values = failure(self.run_id, error)
        self._append("update", status=values["status"], step=values["step"], error=values["error"])


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """All events of a folder."""
    return spark.read.schema(EVENT_SCHEMA).parquet(folder)


def _last_given(column: str) -> Column:
    """Latest value that is neither null nor empty."""
    given = F.col(column).isNotNull() & (F.col(column) != "")
    return F.max_by(column, F.when(given, F.col("event_seq")))


def state(events: DataFrame) -> DataFrame:
    """Current state of every run.

    Status and step keep their value when an update gives none; the error is
    always the one of the latest event, so a later success clears it; payload
    keys are merged, newest value first. Updates of runs that were never created
    are left out. All folds are pre-aggregated, whatever the length of a run.
    """
    runs = events.groupBy("run_id").agg(
        F.max_by("app_name", F.when(F.col("kind") == "create", F.col("event_seq"))).alias("app_name"),
        F.max_by("app_id", F.when(F.col("kind") == "create", F.col("event_seq"))).alias("app_id"),
        _last_given("status").alias("status"),
        _last_given("step").alias("current_step"),
        F.max_by(F.struct("error"), "event_seq")["error"].alias("error"),
        F.min("event_time").alias("created_at"),
        F.max_by("event_time", "event_seq").alias("updated_at"),
        F.count_if(F.col("kind") == "create").alias("_creations"),
    )
    payload = (
        payload_entries(events)
        .groupBy("run_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("payload"))
    )
    known = runs.filter("_creations > 0").drop("_creations")
    empty = F.create_map().cast("map<string,string>")
    return known.join(payload, "run_id", "left").withColumn("payload", F.coalesce("payload", empty))


def payload_entries(events: DataFrame) -> DataFrame:
    """Latest value per (run, payload key)."""
    return (
        events.select("run_id", "event_seq", F.explode("payload").alias("key", "value"))
        .groupBy("run_id", "key")
        .agg(F.max_by(F.struct("value"), "event_seq")["value"].alias("value"))
    )


def get(states: DataFrame, run_id: str) -> DataFrame:
    return states.filter(F.col("run_id") == run_id)


def latest_runs(states: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first; the limit is held between 1 and 100."""
    return states.orderBy(F.desc("created_at"), "run_id").limit(min(max(limit, 1), 100))


def final_status(analyzed: DataFrame, keys=("run_id",)) -> DataFrame:
    """needs_review when any row of the run waits for a person."""
    waiting = F.bool_or(F.coalesce("needs_human_review", F.lit(False)))
    return analyzed.groupBy(*keys).agg(
        F.when(waiting, "needs_review").otherwise("completed").alias("status")
    )


def review_gate(analyzed: DataFrame) -> DataFrame:
    """Does any row need review?"""
    return analyzed.agg(
        F.coalesce(F.bool_or(F.coalesce("needs_human_review", F.lit(False))), F.lit(False)).alias("requires_human_review")
    )


def failure(run_id: str, error: Exception) -> dict:
    """Values of the event that closes a failed run."""
    return {"run_id": run_id, "kind": "update", "status": "failed", "step": "failed",
            "error": f"{type(error).__name__}: {error}"}


def review_outcomes(states: DataFrame, decided: DataFrame) -> DataFrame:
    """Decisions (run_id, approved, notes) against the current state.

    Only runs in needs_review or completed take a decision; the others say why not.
    """
    joined = decided.join(states.select("run_id", "status"), "run_id", "left")
    waiting = F.coalesce(F.col("status").isin("needs_review", "completed"), F.lit(False))
    return joined.select(
        "run_id", "approved", "notes",
        waiting.alias("accepted"),
        F.when(waiting, F.when(F.col("approved"), "completed").otherwise("rejected"))
        .otherwise(F.col("status")).alias("status"),
        F.when(F.col("status").isNull(), "Run not found")
        .when(~waiting, "Run is not awaiting review").alias("reason"),
    )


def review_events(outcomes: DataFrame, seq: Column, now: Column | None = None) -> DataFrame:
    """Ledger events of the accepted decisions."""
    decision = F.to_json(F.struct("approved", F.coalesce("notes", F.lit("")).alias("notes")))
    return outcomes.filter("accepted").select(
        "run_id",
        seq.cast("bigint").alias("event_seq"),
        (F.current_timestamp() if now is None else now).alias("event_time"),
        F.lit("update").alias("kind"),
        F.lit(None).cast("string").alias("app_name"),
        F.lit(None).cast("string").alias("app_id"),
        "status",
        F.lit("human_reviewed").alias("step"),
        F.create_map(F.lit("human_review"), decision).alias("payload"),
        F.lit(None).cast("string").alias("error"),
    )
