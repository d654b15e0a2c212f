"""Global order positions without funnelling rows through one partition.

``row_number() OVER (ORDER BY ord)`` moves the whole table into a single
task.  ``ordered_position`` computes the same dense 1-based position in two
distributed passes: range-partition by the order key, number rows locally
(``monotonically_increasing_id`` = partition index << 33 | local index), then
add per-partition offsets computed from per-partition counts.  The offsets
table has one row per (partition, group), so broadcasting it is bounded by
the partition count times the number of groups — callers only use it with a
fixed, small group set (or none).

The numbered frame is stored once (Parquet in the shared checkpoint folder): the counts and the rows must come from the
same range partitioning, and two separate range shuffles may sample
different bounds or be coalesced differently by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.session import stored

_LOCAL_MASK = (1 << 33) - 1


def ordered_position(df: DataFrame, order_cols: list, group_cols: list | None = None,
                     out: str = "pos") -> DataFrame:
    """Add ``out`` = 1-based position of each row by ``order_cols`` within ``group_cols``.

    ``order_cols`` must make the order total (end with a unique key).
    """
    group_cols = list(group_cols or [])
    keys = [*group_cols, *order_cols]
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.select("*", F.shiftright("_mid", 33).alias("_pid"),
                           F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)).alias("_loc"))
    ranged = stored(ranged, "positions")
    stats = ranged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_pid", *group_cols, "_first",
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    joined = ranged.join(F.broadcast(stats), ["_pid", *group_cols])
    return (joined.withColumn(out, F.col("_offset") + F.col("_loc") - F.col("_first") + 1)
            .drop("_mid", "_pid", "_loc", "_first", "_offset"))
