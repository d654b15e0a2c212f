"""Digest assembly: priority cap, item blocks, sources, fallback, subject, topic groups.

Operators T1, T2, F14, A7, W3, F16, F17, F18, F19, F22, A8, U6.  After the
priority cap there are at most ``max_synthesis_items`` rows, so the ordered
string aggregations here work on a bounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sifter.functions import constants as K
from sifter.functions.templates import fill
from sifter.functions.text import truncate, truncate_ellipsis
from sifter.operators.extract import extract_items
from sifter.operators.model_calls import CallPolicy, ClientPerPartition, ModelFn, answered
from sifter.session import stored


def priority(category) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    out = None
    for name, p in K.CATEGORY_PRIORITY:
        out = F.when(c == name, F.lit(p)) if out is None else out.when(c == name, F.lit(p))
    return out.otherwise(F.lit(2))


def priority_cap(items: DataFrame, max_items: int) -> DataFrame:
    """Stable sort high=0, general=1, other=2 (ties in input order), first ``max_items``.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: a per-partition
    top-n and a merge of n rows per partition, never a full sort.
    """
    return (items.withColumn("priority", priority("category"))
            .orderBy(F.col("priority"), F.col("ord")).limit(max_items))


def capped_items(kept: DataFrame, pages: DataFrame, cfg, summarizer=None) -> DataFrame:
    """T1 before extraction: the first ``max_synthesis_items`` kept messages by priority, extracted."""
    top = stored(priority_cap(kept, cfg.max_synthesis_items).drop("priority"), "capped")
    items = extract_items(top, pages, cfg, summarizer=summarizer)
    return items.withColumn("priority", priority("category"))


def score_sort(df: DataFrame) -> DataFrame:
    """Score-descending stable sort (ties in input order)."""
    return df.orderBy(F.col("relevance_score").desc(), F.col("ord"))


def topics_text(topics: Column, empty: str) -> Column:
    return F.when(F.coalesce(F.size(topics), F.lit(0)) > 0, F.array_join(topics, ", ")).otherwise(F.lit(empty))


def item_block(source, topics, category, summary, link) -> Column:
    """the synthesis template for one item (content capped at 1500 + '...')."""
    return fill(K.SYNTHESIS_ITEM_TEMPLATE, source=F.col(source), topics=topics_text(F.col(topics), K.ITEM_NO_TOPICS),
                category=F.coalesce(F.col(category), F.lit("None")),
                content=truncate_ellipsis(F.col(summary), K.ITEM_CONTENT_CHARS),
                link=F.coalesce(F.col(link), F.lit(K.ITEM_NO_LINK)))


def ordered_text(value: Column, order: Column, sep: str) -> Column:
    """Aggregate over a bounded group: values joined by ``sep`` in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))),
                                    lambda x: x["v"]), sep)


def digest_items_block(capped: DataFrame) -> DataFrame:
    """Item blocks joined with newline in priority order (one row)."""
    blocks = capped.select(F.struct("priority", "ord").alias("_o"),
                           item_block("source_name", "topics", "category", "summary_text", "link_url").alias("b"))
    return blocks.agg(F.count(F.lit(1)).alias("n_items"), ordered_text(F.col("b"), F.col("_o"), "\n").alias("items_block"))


def synthesis_prompt(items_block: Column) -> Column:
    return fill(K.SYNTHESIS_USER, items_block=items_block)


def first_per_key(items: DataFrame) -> DataFrame:
    """First item per email id in priority order; rows with an empty id are skipped."""
    w = Window.partitionBy("email_id").orderBy("priority", "ord")
    return (items.where(F.coalesce(F.col("email_id"), F.lit("")) != "")
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def source_bullet(subject, source, email_id) -> Column:
    """F16: ``- [subject or source](deep link) — *source*``."""
    s = F.col(subject)
    title = F.when(F.coalesce(s, F.lit("")) != "", s).otherwise(F.col(source))
    return F.concat(F.lit("- ["), title, F.lit("]("), F.lit(K.MAIL_DEEP_LINK), F.col(email_id), F.lit(") — *"),
                    F.col(source), F.lit("*"))


def sources_section(capped: DataFrame) -> DataFrame:
    """F16 + W3 + P9: one row; '' when there is no bullet."""
    firsts = first_per_key(capped)
    agg = firsts.agg(F.count(F.lit(1)).alias("n_sources"),
                     ordered_text(source_bullet("email_subject", "source_name", "email_id"),
                                  F.struct("priority", "ord"), "\n").alias("_lines"))
    return agg.select("n_sources", F.when(F.col("n_sources") == 0, F.lit(""))
                      .otherwise(F.concat(F.lit(K.SOURCES_HEADER + "\n"), F.col("_lines"))).alias("sources_md"))


def fallback_line(source, summary, link) -> Column:
    """F17 bullet: ``- **source**: summary[:200]`` + optional `` — [link](url)``."""
    return F.concat(F.lit("- **"), F.col(source), F.lit("**: "), truncate(F.col(summary), K.FALLBACK_BULLET_CHARS),
                    F.when(F.coalesce(F.col(link), F.lit("")) != "",
                           F.concat(F.lit(" — [link]("), F.col(link), F.lit(")"))).otherwise(F.lit("")))


def fallback_digest(capped: DataFrame) -> DataFrame:
    """F17 (+ F18 when empty): one row (n_items, fallback_md)."""
    agg = capped.agg(F.count(F.lit(1)).alias("n_items"),
                     ordered_text(fallback_line("source_name", "summary_text", "link_url"),
                                  F.struct("priority", "ord"), "\n").alias("_lines"))
    return agg.select("n_items", F.when(F.col("n_items") == 0, F.lit(K.EMPTY_DIGEST))
                      .otherwise(F.concat(F.lit(K.FALLBACK_HEADER + "\n"), F.col("_lines"))).alias("fallback_md"))


def append_sources(md: Column, sources_md: Column) -> Column:
    """digest + blank line + sources when the section is non-empty."""
    return F.when(F.coalesce(sources_md, F.lit("")) != "", F.concat(md, F.lit("\n\n"), sources_md)).otherwise(md)


def digest_subject(as_of_epoch: Column) -> Column:
    """``Newsletter Briefing — Morning|Evening, Month dd, yyyy`` (UTC)."""
    ts = F.timestamp_seconds(as_of_epoch)
    period = F.when(F.hour(ts) < K.MORNING_BEFORE_HOUR, F.lit("Morning")).otherwise(F.lit("Evening"))
    return F.concat(F.lit(K.SUBJECT_PREFIX), period, F.lit(", "), F.date_format(ts, "MMMM dd, yyyy"))


def topic_digest(items: DataFrame) -> DataFrame:
    """Items grouped by topic, one row per (topic, source).

    Topic totals (items, high-relevance items, distinct sources) come from a
    second map-side-combined aggregation joined back, so no group is ever
    collected into an array (a topic may hold a third of all items).  A topic
    with a single general-info item belongs to the Quick Hits section.
    """
    t = items.select(F.explode_outer("topics").alias("topic"), "source_name", "category")
    t = t.withColumn("topic", F.coalesce(F.col("topic"), F.lit(K.ITEM_NO_TOPICS)))
    pairs = t.groupBy("topic", "source_name").agg(
        F.count(F.lit(1)).alias("n_from_source"),
        F.count_if(F.col("category") == K.CATEGORY_HIGH).alias("_high"))
    totals = pairs.groupBy("topic").agg(F.sum("n_from_source").alias("n_items"), F.sum("_high").alias("n_high"),
                                        F.count(F.lit(1)).alias("n_sources"))
    j = pairs.drop("_high").join(totals, "topic")
    return j.withColumn("section", F.when((F.col("n_items") == 1) & (F.col("n_high") == 0), F.lit(K.QUICK_HITS))
                        .otherwise(F.col("topic")))


def write_digest(prompt_row: DataFrame, model: ModelFn | ClientPerPartition | None, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """One model call per digest prompt row; NULL when there is no model or it raises."""
    if model is None:
        return prompt_row.withColumn("model_md", F.lit(None).cast("string"))
    cols = prompt_row.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answered(batches, model, policy, lambda p: [(K.SYNTHESIS_SYSTEM, x) for x in p["prompt"]], "model_md")

    schema = StructType([*prompt_row.schema.fields, StructField("model_md", StringType())])
    return prompt_row.mapInPandas(run, schema).select(*cols, "model_md")


def digest_parts(capped: DataFrame) -> DataFrame:
    """One aggregation over the capped items giving every part of the digest:
    (n_items, items_block, fallback_md, sources_md).

    The capped set is read once (no scalar subqueries re-running the
    extraction); first-per-email-id (W3) is applied inside the sorted array
    of at most ``max_synthesis_items`` entries.
    """
    row = F.struct(F.col("priority").alias("p"), F.col("ord").alias("o"), F.col("email_id").alias("email_id"),
                   item_block("source_name", "topics", "category", "summary_text", "link_url").alias("block"),
                   fallback_line("source_name", "summary_text", "link_url").alias("line"),
                   source_bullet("email_subject", "source_name", "email_id").alias("bullet"))
    agg = capped.agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(row)).alias("_rows"))
    rows = F.col("_rows")
    with_id = F.filter(rows, lambda x: F.coalesce(x["email_id"], F.lit("")) != "")
    firsts = F.filter(with_id, lambda x, i: ~F.exists(F.slice(with_id, 1, i), lambda y: y["email_id"] == x["email_id"]))
    bullets = F.transform(firsts, lambda x: x["bullet"])
    return agg.select(
        "n_items",
        F.array_join(F.transform(rows, lambda x: x["block"]), "\n").alias("items_block"),
        F.when(F.col("n_items") == 0, F.lit(K.EMPTY_DIGEST)).otherwise(
            F.concat(F.lit(K.FALLBACK_HEADER + "\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")))
        .alias("fallback_md"),
        F.when(F.size(bullets) == 0, F.lit("")).otherwise(
            F.concat(F.lit(K.SOURCES_HEADER + "\n"), F.array_join(bullets, "\n"))).alias("sources_md"))
