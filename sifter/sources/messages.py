"""The messages table as stored for production runs (S1 source).

Written as Parquet partitioned by ``received_date`` (UTC day of arrival) and
read back with an explicit schema, so ``scan_incremental``'s cutoff prunes
whole day partitions and its ``received_epoch`` predicate is pushed into the
remaining files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES_SCHEMA = ("id string, ord long, subject string, sender string, received_epoch long, "
                   "label_ids array<string>, snippet string, body_html string, body_text string, "
                   "received_date date")


def with_received_date(messages: DataFrame) -> DataFrame:
    return messages.withColumn("received_date", F.to_date(F.timestamp_seconds(F.col("received_epoch"))))


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Land messages partitioned by arrival day (new days append, replays of a
    day overwrite only that day when ``mode='overwrite'`` with dynamic overwrite)."""
    (with_received_date(messages).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("received_date").parquet(path))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Explicit schema: no inference pass over the files."""
    return spark.read.schema(MESSAGES_SCHEMA).parquet(path)
