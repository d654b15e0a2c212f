"""Joins whose key may be hot: the rows of a hot key are dealt over many tasks by a salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task may well take.
ROWS_A_TASK = 50_000


def salted_join(left: DataFrame, right: DataFrame, key: str, deal_by: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Left join of ``left`` (many rows a key) with ``right`` (one row a key) on ``key``.

    Keys with more than ``rows_a_task`` left rows are split into as many parts, by a
    hash of ``deal_by``; their right row is repeated once for each part.  The list of
    hot keys is broadcast: it has fewer entries than left rows / ``rows_a_task``, and
    each part is a task's work, so it is smaller than the number of tasks that the
    rows need anyway.  ``left`` is read twice (once for its keys only)."""
    hot = (left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_a_task)
           .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / rows_a_task).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(deal_by), parts).cast("int")).drop("_hot", "_parts")
    repeated = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")
