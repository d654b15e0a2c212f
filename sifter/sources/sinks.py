"""Outputs of a run: inbox actions, fetched listing, triage report, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions.text import truncate
from sifter.operators.ordering import ordered_position


def inbox_actions(results: DataFrame) -> DataFrame:
    """Kept -> add the label (stays unread); every other result -> mark read.

    Batches of 1000 ids per action in input order; the two action groups are
    a fixed set, so the position pass stays distributed.
    """
    acts = results.select("id", "ord", F.when(F.col("kept"), F.lit("label")).otherwise(F.lit("mark_read"))
                          .alias("action"))
    pos = ordered_position(acts, ["ord"], ["action"])
    return pos.select("id", "action", F.when(F.col("action") == "label", F.lit(K.KEEP_LABEL)).alias("label"),
                      F.floor((F.col("pos") - 1) / K.ACTION_BATCH_SIZE).cast("long").alias("batch_no"))


def header_date(epoch_col) -> F.Column:
    return F.date_format(F.timestamp_seconds(epoch_col), "EEE, dd MMM yyyy HH:mm:ss '+0000'")


def fetched_listing(fetched: DataFrame, query: str = K.FETCH_QUERY) -> DataFrame:
    """Numbered listing of fetched messages: subject, from, date, snippet[:120],
    with ``line`` = the entry as the text dump shows it; number 0 is the head line."""
    pos = ordered_position(fetched.select("ord", "subject", "sender", "received_epoch", "snippet"), ["ord"])
    out = pos.select(F.col("pos").alias("n"), "subject", "sender", header_date(F.col("received_epoch")).alias("date"),
                     truncate(F.col("snippet"), K.LISTING_SNIPPET_CHARS).alias("snippet"))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("subject"), F.lit("\n   From: "), F.col("sender"),
                    F.lit("\n   Date: "), F.col("date"), F.lit("\n   Snippet: "), F.col("snippet"), F.lit("\n"))
    head = fetched.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(0).cast("long").alias("n"), F.concat(F.lit("Fetched "), F.col("_n").cast("string"),
                                                   F.lit(f" emails (query: {query})\n")).alias("line"))
    return out.withColumn("line", line).unionByName(head, allowMissingColumns=True)


def write_lines(report: DataFrame, path: str, order_cols: list) -> None:
    """Write a report's ``line`` column as text in report order.

    A global sort range-partitions the rows, so the part files, read in name
    order, are the whole report in order — no single task writes everything.
    """
    report.orderBy(*order_cols).select("line").write.mode("overwrite").text(path)


def triage_report(results: DataFrame) -> DataFrame:
    """KEPT and DISCARDED sections, each by score descending (ties in input order); rank 0 is a
    section's head, above the first one also the report's."""
    r = results.select("id", "ord", "subject", "sender", "category", "relevance_score", "topics", "reason",
                       F.when(F.col("kept"), F.lit("KEPT")).otherwise(F.lit("DISCARDED")).alias("section"))
    pos = ordered_position(r, [F.col("relevance_score").desc(), F.col("ord")], ["section"], out="rank")
    topics = F.when(F.coalesce(F.size("topics"), F.lit(0)) > 0, F.array_join("topics", ", ")) \
        .otherwise(F.lit(K.REPORT_NO_TOPICS))
    out = pos.select("section", "rank", "id", "category",
                     F.format_string("%.2f", F.col("relevance_score")).alias("score"), "subject", "sender",
                     F.when(F.col("section") == "KEPT", topics).alias("topics"), "reason")
    line = F.concat(F.lit("  ["), F.coalesce(F.col("category"), F.lit("None")), F.lit("] score="), F.col("score"),
                    F.lit("  "), F.col("subject"), F.lit("\n    From: "), F.col("sender"),
                    F.when(F.col("section") == "KEPT", F.concat(F.lit("\n    Topics: "), F.col("topics")))
                    .otherwise(F.lit("")),
                    F.lit("\n    Reason: "), F.coalesce(F.col("reason"), F.lit("None")), F.lit("\n"))
    sections = [F.struct(F.lit(name).alias("section"), F.concat(
        title, F.lit(f"{K.REPORT_RULE}\n{name}\n{K.REPORT_RULE}")).alias("line")) for name, title in (
            ("KEPT", F.concat(F.lit("Triage results: "), F.col("_kept").cast("string"), F.lit(" kept / "),
                              F.col("_all").cast("string"), F.lit(" total\n\n"))), ("DISCARDED", F.lit("")))]
    heads = results.agg(F.count_if("kept").alias("_kept"), F.count(F.lit(1)).alias("_all")).select(
        F.inline(F.array(*sections))).withColumn("rank", F.lit(0).cast("long"))
    return out.withColumn("line", line).unionByName(heads, allowMissingColumns=True)


def digest_sink(digest: DataFrame, path: str | None, dry_run: bool) -> DataFrame:
    """Write the digest (subject, markdown) unless dry run; always return it."""
    if path and not dry_run:
        digest.coalesce(1).write.mode("overwrite").parquet(path)
    return digest
