"""Processed-message and run-log state (S7, S8, S9) over a keyed state folder.

Every write is published by one ledger entry of its run (``keyed_state``), so a
replay of a run that was published changes nothing and one that was not leaves
nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.sources.keyed_state import PROCESSED_SCHEMA, RUNS_SCHEMA, KeyedState  # noqa: F401  (the schemas of the tables)


def read_state(spark: SparkSession, state_dir: str) -> tuple[DataFrame, DataFrame]:
    """(processed_messages, runs); a missing folder reads as empty tables."""
    state = KeyedState(spark, state_dir)
    return state.processed(), state.runs()


def new_processed_rows(processed: DataFrame, new_ids: DataFrame, as_of_epoch: Column) -> DataFrame:
    """S8 delta: ids not yet in the state (first ``processed_epoch`` wins; re-insert is a no-op)."""
    fresh = new_ids.select(F.col("id").alias("message_id")).dropDuplicates(["message_id"])
    return (fresh.join(processed.select("message_id"), "message_id", "left_anti")
            .select("message_id", as_of_epoch.cast("long").alias("processed_epoch")))


def append_processed(spark: SparkSession, state_dir: str, new_ids: DataFrame, as_of_epoch: int,
                     run_id: int) -> int:
    """S8 sink: publish the ids that the state does not have and return their number.

    A replay of the run publishes nothing: its ids keep their first ``processed_epoch``."""
    state, name = KeyedState(spark, state_dir), f"ids-{run_id:012d}"
    if state.is_published(name):
        return 0
    segment, n = state.stage_ids(new_ids, as_of_epoch, run_id)
    return n if state.publish(name, {"segment": segment}) else 0


def next_run_row(runs: DataFrame, as_of_epoch: Column, messages_processed: Column) -> DataFrame:
    """S9 delta: one row (max id + 1, as_of, n)."""
    return runs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select(
        "id", as_of_epoch.cast("long").alias("ran_epoch"), messages_processed.cast("long").alias("messages_processed"))


def append_run(spark: SparkSession, state_dir: str, as_of_epoch: int, messages_processed: int, run_id: int) -> None:
    """S9 sink: publish the run row (a replay changes nothing)."""
    KeyedState(spark, state_dir).publish(
        f"run-{run_id:012d}", {"run": {"id": run_id, "ran_epoch": as_of_epoch, "messages_processed": messages_processed}})
