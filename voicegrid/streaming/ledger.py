"""The run ledger kept up to date from a stream of event files.

State per run: for each field the value that counts and the number of the event it came from, and per payload key its
newest value. Events may come in any order and in batches of any size; the table read at the end is the fold of
all events, as `operators.ledger.state` gives it.

Each micro-batch writes the runs it changed under its own number, so a batch that runs again after a failure replaces its own
rows. Reading takes the last row of every run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voicegrid.operators.ledger import EVENT_SCHEMA

FIELDS = ("app_name", "app_id", "status", "current_step", "error")
STATE = "held string"
CHANGED = "run_id string, " + ", ".join(f"{f} string" for f in FIELDS) + ", created_at bigint, updated_at bigint, payload string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 200) -> DataFrame:
    """Stream of ledger events from parquet files."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _merged(held: dict, row) -> None:
    """Take one event into a run's state; for each field the event of the highest number that gives it counts."""

    def newer(name: str, value) -> None:
        if name not in held["at"] or row.event_seq >= held["at"][name]:
            held["at"][name], held[name] = row.event_seq, value

    if row.kind == "create":
        held["created"] = True
        newer("app_name", row.app_name)
        newer("app_id", row.app_id)
    if row.status:
        newer("status", row.status)
    if row.step:
        newer("current_step", row.step)
    newer("error", row.error)
    if row.micros is not None:
        held["created_at"] = row.micros if held["created_at"] is None else min(held["created_at"], row.micros)
    newer("updated_at", row.micros)
    for key, value in json.loads(row.entries or "{}").items():
        if key not in held["keys"] or row.event_seq >= held["keys"][key][0]:
            held["keys"][key] = [row.event_seq, value]


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {
        "at": {}, "keys": {}, "created": False, "created_at": None, "updated_at": None, **dict.fromkeys(FIELDS)
    }
    for frame in frames:
        for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
            _merged(held, row)
    state.update((json.dumps(held),))
    if held["created"]:
        payload = {k: v for k, (_, v) in sorted(held["keys"].items())}
        values = [key[0], *(held[f] for f in FIELDS), held["created_at"], held["updated_at"], json.dumps(payload)]
        yield pd.DataFrame([values], columns=["run_id", *FIELDS, "created_at", "updated_at", "payload"]).astype(object)


def keep_states(stream: DataFrame, path: str, checkpoint: str):
    """Fold new events into the states under `path`; reads what is there and stops."""
    flat = stream.filter("run_id IS NOT NULL").select(
        "run_id", "event_seq", "kind", "app_name", "app_id", "status", "step", "error",
        F.unix_micros("event_time").alias("micros"), F.to_json("payload", {"ignoreNullFields": "false"}).alias("entries"),
    )
    folded = flat.groupBy("run_id").applyInPandasWithState(_fold, CHANGED, STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")

    return (
        folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def states(spark: SparkSession, path: str) -> DataFrame:
    """Current state of every run, with the columns of `operators.ledger.state`."""
    rows = spark.read.schema(f"{CHANGED}, batch bigint").parquet(f"{path}/batch-*")
    columns = [c for c in rows.columns if c not in ("run_id", "batch")]
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("run_id", "s.*")
    return last.withColumns({
        "created_at": F.timestamp_micros("created_at"), "updated_at": F.timestamp_micros("updated_at"),
        "payload": F.from_json("payload", "map<string,string>"),
    })
