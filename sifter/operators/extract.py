"""Extraction: body text, best link, page lookup, article combine, token windows, summaries.

Operators F10, P7, A3, S6/J4, F5, F11, F20, P8, W4, U4, A6, U1, F2.
Everything is per-row native work except the optional model summariser (U4)
and the page lookup join (one shuffle over narrow columns).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.functions import constants as K
from sifter.functions.html import html_to_text, main_content
from sifter.functions.links import best_link
from sifter.functions.text import source_name, token_slice_text, word_pieces
from sifter.operators.model_calls import CallPolicy, ClientPerPartition, ModelFn, answered
from sifter.operators.skew import ROWS_A_TASK, salted_join
from sifter.session import stored



def choose_body(body_html: Column, body_text: Column) -> Column:
    """stripped HTML if there is HTML, else the raw text (unstripped)."""
    return F.when(F.coalesce(body_html, F.lit("")) != "", html_to_text(body_html)).otherwise(body_text)


def computed_once(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """``keep`` and the non-NULL ``value``s: the expensive expression goes through a generator, so
    no filter on it is pushed down to be evaluated a second time."""
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name)).where(F.col(name).isNotNull())


def message_links(messages: DataFrame) -> DataFrame:
    """A3: (id, link_url) of the messages that have a best link."""
    return computed_once(messages, ["id"], best_link("body_html"), "link_url")


def gated_links(kept: DataFrame) -> DataFrame:
    """P7 + A3: (id, link_url), looked for in high-relevance messages only."""
    return message_links(kept.where(F.col("category") == K.CATEGORY_HIGH))


def fetched_pages(pages: DataFrame) -> DataFrame:
    """The crawled pages that count: status 200 to 299 and ``html`` in the content type, where the table
    tells them (``status``, ``content_type``); a NULL there is a fetch that failed or told no type."""
    out = pages
    if "status" in pages.columns:
        out = out.where(F.col("status").between(200, 299))
    if "content_type" in pages.columns:
        out = out.where(F.contains(F.col("content_type"), F.lit("html")))
    return out


def page_contents(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """S6/J4 lookup side: main content of the crawled page behind each needed URL.

    The page is picked on narrow columns (a URL crawled twice keeps its lowest
    page_id); only then is the html of the picked pages read and parsed, once
    per page no matter how many messages link to it.
    """
    needed = urls.select(F.col("link_url").alias("url")).where(F.col("url").isNotNull()).distinct()
    pages = fetched_pages(pages)
    picked = (pages.select("page_id", "url").join(needed, "url", "left_semi")
              .groupBy("url").agg(F.min("page_id").alias("page_id")))
    found = pages.select("page_id", "url", "html").join(picked, ["page_id", "url"])
    return computed_once(found, [F.col("url").alias("link_url")], main_content("html"), "article")


def lookup_page(links: DataFrame, pages: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(id, link_url) -> (id, link_url, article); an unknown URL, an error page or one that is no HTML -> ''.

    ``links`` is read more than once (the needed URLs and the rows), so the narrow pairs are
    stored once.  Rows without a link never enter the join (no NULL-key hot partition); a URL that
    very many messages link to is dealt over several tasks.
    """
    with_link = stored(links.where(F.col("link_url").isNotNull()).select("id", "link_url"), "links")
    found = salted_join(with_link, page_contents(with_link, pages), "link_url", "id", rows_a_task)
    return found.select("id", "link_url", F.coalesce(F.col("article"), F.lit("")).alias("article"))


def combine_article(body: Column, article: Column) -> Column:
    """body + separator + article, only when the article is non-empty."""
    a = F.coalesce(article, F.lit(""))
    return F.when(a != "", F.concat(body, F.lit(K.LINKED_ARTICLE_SEPARATOR), a)).otherwise(body)


def window_starts(n_tokens: Column, stride: int) -> Column:
    """Window starts 0, stride, 2*stride, ... while start < n (empty for n = 0)."""
    return F.when(n_tokens > 0, F.sequence(F.lit(0), n_tokens - 1, F.lit(stride))).otherwise(
        F.array().cast("array<int>"))


def token_windows(tokens: Column, budget: int, stride: int) -> Column:
    """Array of struct(chunk_no, start, chunk_text) over a word-piece array."""
    starts = window_starts(F.size(tokens), stride)
    return F.transform(starts, lambda p, i: F.struct(i.alias("chunk_no"), p.alias("start"),
                                                       token_slice_text(tokens, p, budget).alias("chunk_text")))


def chunk_fallback(chunk_text: Column) -> Column:
    """U4 failure path: first 500 characters + '...' (always appended)."""
    return F.concat(F.substring(chunk_text, 1, K.CHUNK_FALLBACK_CHARS), F.lit("..."))


def native_chunked_summary(tokens: Column, cfg: DigestConfig) -> Column:
    """W4 + U4 (no model) + A6 within the row: every window's fallback summary,
    joined by a blank line — no explode, no regroup shuffle."""
    wins = token_windows(tokens, cfg.token_budget, cfg.window_stride)
    return F.array_join(F.transform(wins, lambda w: chunk_fallback(w["chunk_text"])), "\n\n")


def summarize_windows(windows: DataFrame, model: ModelFn | ClientPerPartition, parallelism: int | None = None,
                      policy: CallPolicy = CallPolicy()) -> DataFrame:
    """U4 with a model: (id, chunk_no, chunk_text) -> + summary; an exception -> fallback.

    The windows are dealt over ``parallelism`` tasks (default: the shuffle
    partitions) by id and window, so a long document does not serialise its
    calls in one task; the caller regroups them by id (A6) and stores the result
    before reading it twice.
    """
    tasks = parallelism or int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return answered(batches, model, policy, lambda p: [
            (K.CHUNK_SUMMARY_SYSTEM, K.CHUNK_SUMMARY_USER.format(chunk=c)) for c in p["chunk_text"]], "summary")

    scored = windows.select("id", "chunk_no", "chunk_text").repartition(tasks, "id", "chunk_no").mapInPandas(
        run, "id string, chunk_no int, chunk_text string, summary string")
    return scored.select("id", "chunk_no", F.coalesce(F.col("summary"), chunk_fallback(F.col("chunk_text")))
                         .alias("summary"))


def join_summaries(summaries: DataFrame) -> DataFrame:
    """Chunk summaries joined by a blank line in chunk order, one row per id."""
    return summaries.groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk_no", "summary"))), lambda x: x["summary"]), "\n\n")
        .alias("summary_text"))


def extract_items(kept: DataFrame, pages: DataFrame, cfg: DigestConfig,
                  summarizer: ModelFn | None = None) -> DataFrame:
    """Kept triage results -> extracted items (one per input row, order key kept).

    ``kept`` needs id, ord, sender, subject, snippet, body_html, body_text,
    category, topics.
    """
    base = kept.select("id", "ord", "sender", "subject", "snippet", "category", "topics", "body_html", "body_text")
    art = lookup_page(gated_links(base), pages)
    # only messages that can have a link are joined; the others keep their place
    gate = F.coalesce(F.col("category") == K.CATEGORY_HIGH, F.lit(False))
    j = base.where(gate).join(art, "id", "left").unionByName(
        base.where(~gate).withColumns({"link_url": F.lit(None).cast("string"), "article": F.lit(None).cast("string")}))
    j = j.withColumn("body", choose_body(F.col("body_html"), F.col("body_text"))).drop("body_html", "body_text")
    combined = j.select("*", combine_article(F.col("body"), F.col("article")).alias("full_content")) \
        .drop("body", "article")
    tok = combined.withColumn("_tokens", word_pieces(F.col("full_content")))
    over = F.size("_tokens") > cfg.token_budget                     # P8: strictly over budget
    if summarizer is None:
        summarized = tok.withColumn("summary_text", F.when(over, native_chunked_summary(F.col("_tokens"), cfg))
                                    .otherwise(F.col("full_content")))
    else:
        long_rows = tok.where(over)
        windows = long_rows.select("id", F.inline(token_windows(F.col("_tokens"), cfg.token_budget,
                                                                 cfg.window_stride)))
        joined = stored(join_summaries(summarize_windows(windows, summarizer)), "summaries")
        summarized = tok.join(joined, "id", "left").withColumn(
            "summary_text", F.when(over, F.col("summary_text")).otherwise(F.col("full_content")))
    return union_fallback(summarized.drop("_tokens"))


def item_headers(kept: DataFrame) -> DataFrame:
    """The columns of the extracted items that need no extraction: extraction keeps one row for each message."""
    return kept.select(F.col("id").alias("email_id"), "ord", source_name(F.col("sender")).alias("source_name"), "topics",
                       "category", F.col("subject").alias("email_subject"))


def union_fallback(items: DataFrame) -> DataFrame:
    """An item whose extraction produced nothing falls back to its snippet, with
    no link and empty full content — in the same pass (no union, order kept)."""
    ok = F.col("summary_text").isNotNull()
    return items.select(
        F.col("id").alias("email_id"), "ord",
        source_name(F.col("sender")).alias("source_name"),
        "topics", "category",
        F.when(ok, F.col("summary_text")).otherwise(F.col("snippet")).alias("summary_text"),
        F.when(ok, F.col("link_url")).alias("link_url"),
        F.when(ok, F.col("full_content")).otherwise(F.lit("")).alias("full_content"),
        F.col("subject").alias("email_subject"))
