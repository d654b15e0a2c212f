"""Cutoff, incremental scan and dedupe against processed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.config import DigestConfig

SECONDS_PER_DAY = 86400


def last_run(runs: DataFrame) -> DataFrame:
    """A4: ``ran_epoch`` of the run with the greatest id (not the latest time); NULL if none.

    A global aggregate always yields exactly one row.
    """
    return runs.agg(F.max_by("ran_epoch", "id").alias("last_ran_epoch"))


def resolve_cutoff(runs: DataFrame, as_of_epoch: Column, cfg: DigestConfig) -> DataFrame:
    """Override days -> last run -> initial lookback, as one row (cutoff_epoch, cutoff_source)."""
    lr = last_run(runs)
    if cfg.lookback_days_override is not None:
        return lr.select((as_of_epoch - cfg.lookback_days_override * SECONDS_PER_DAY).alias("cutoff_epoch"),
                         F.lit("override").alias("cutoff_source"))
    return lr.select(
        F.coalesce(F.col("last_ran_epoch"), as_of_epoch - cfg.initial_lookback_days * SECONDS_PER_DAY)
        .alias("cutoff_epoch"),
        F.when(F.col("last_ran_epoch").isNull(), F.lit("initial_lookback")).otherwise(F.lit("last_run"))
        .alias("cutoff_source"))


def has_labels(label_ids: Column, labels) -> Column:
    cond = F.lit(True)
    for lab in labels:
        cond = cond & F.array_contains(label_ids, lab)
    return cond


def cutoff_value(cutoff: DataFrame) -> int:
    """The one-row cutoff, collected once on the driver (a single number)."""
    return int(cutoff.select(F.floor("cutoff_epoch")).first()[0])


def scan_incremental(messages: DataFrame, cutoff: DataFrame | int | None, cfg: DigestConfig,
                     label_predicate: Column | None = None) -> DataFrame:
    """Label predicate (default: all required labels) and ``received_epoch > cutoff``.

    The cutoff is a plain literal so the comparison reaches the Parquet scan
    (``PushedFilters``); when the table is partitioned by ``received_date`` the
    matching date predicate prunes whole partitions.  ``cutoff=None`` means no
    time predicate.
    """
    pred = label_predicate if label_predicate is not None else has_labels(F.col("label_ids"), cfg.required_labels)
    out = messages.where(pred)
    if cutoff is not None:
        since = cutoff_value(cutoff) if isinstance(cutoff, DataFrame) else int(cutoff)
        out = out.where(F.col("received_epoch") > F.lit(since))
        if "received_date" in messages.columns:
            out = out.where(F.col("received_date") >= F.to_date(F.timestamp_seconds(F.lit(since))))
    return out


def anti_join_processed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages whose id is not in the processed table.

    The processed table grows without bound while one run brings comparatively
    few ids, so the state is first reduced to the ids of this run with a
    semi-join (the run's ids are the build side: the state is scanned, not
    shuffled, when they fit a broadcast) and the anti-join runs against
    that small hit set.
    """
    ids = messages.select("id")
    hits = processed.select(F.col("message_id").alias("id")).join(ids, "id", "left_semi")
    return messages.join(hits, "id", "left_anti")


def new_vs_seen(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """A2: counts of new and already-processed messages, one row.

    The processed table is unique by id (``append_processed`` keeps it so);
    it is reduced to this run's ids before the join, as in J1.
    """
    ids = messages.select("id")
    hits = (processed.select(F.col("message_id").alias("id")).join(ids, "id", "left_semi")
            .select("id", F.lit(True).alias("_seen")))
    j = ids.join(hits, "id", "left")
    return j.agg(F.count_if(F.col("_seen").isNull()).alias("n_new"),
                 F.count_if(F.col("_seen").isNotNull()).alias("n_seen"))
