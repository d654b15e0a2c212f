"""Registered extraction queries (S6/J4, F11, P8, W4, U4, A6, U1) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.functions import constants as K
from sifter.functions import text as T
from sifter.functions.models import lead_model
from sifter.operators import extract as X
from sifter.operators import triage as TR
from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.sources.fixtures import Fixtures

THR = CFG.triage_score_threshold
# Windows are exercised at a budget of 200 word pieces: at the default 4000
# only one sf0.01 document is long enough to be split.
WCFG = DigestConfig(token_budget=200)

SQL_KEPT_M = ("kept_m", f"""
SELECT m.id, m.ord, m.sender, m.subject, m.snippet, m.body_html, m.body_text, v.category, v.topics
FROM messages m JOIN verdicts v ON v.id = m.id
WHERE {O.keep_flag('v.category', 'v.relevance_score', THR)}""")
SQL_BASE = ("base", f"""
SELECT *, CASE WHEN body_html <> '' THEN {O.html_to_text('body_html')} ELSE body_text END AS body FROM kept_m""")
SQL_HIGH = ("high_m", f"SELECT id, body_html FROM kept_m WHERE category = '{K.CATEGORY_HIGH}'")
SQL_PG = ("pg", "SELECT url, arg_min(html, page_id) AS html FROM pages GROUP BY url")
SQL_ART = ("art", f"""
SELECT b.id, b.link_url, coalesce({O.main_content('pg.html')}, '') AS article
FROM hl_best b LEFT JOIN pg ON pg.url = b.link_url""")
SQL_ITEMS = ("items", f"""
SELECT base.*, art.link_url,
       CASE WHEN coalesce(art.article, '') <> '' THEN concat(body, {O.q(K.LINKED_ARTICLE_SEPARATOR)}, art.article)
            ELSE body END AS full_content
FROM base LEFT JOIN art ON art.id = base.id""")
SQL_TOK = ("tok", f"SELECT *, {O.word_pieces('full_content')} AS t FROM items")
EXTRACT_CTES = [SQL_KEPT_M, SQL_BASE, SQL_HIGH, *O.best_link_ctes("hl", "high_m"), SQL_PG, SQL_ART, SQL_ITEMS]

SQL_WTOK = ("wtok", f"SELECT id, {O.word_pieces('body_text')} AS t FROM messages")
SQL_WINDOWS = ("windows", f"""
SELECT id, chunk_no, start, array_to_string(list_slice(t, start + 1, start + {WCFG.token_budget}), '') AS chunk_text
FROM (SELECT id, t, unnest(generate_series(0, len(t) - 1, {WCFG.window_stride})) AS start,
             generate_subscripts(generate_series(0, len(t) - 1, {WCFG.window_stride}), 1) - 1 AS chunk_no
      FROM wtok WHERE len(t) > 0)""")


def kept_messages(fx: Fixtures) -> DataFrame:
    v = fx.verdicts().select("id", "category", "relevance_score", "topics")
    m = fx.messages().select("id", "ord", "sender", "subject", "snippet", "body_html", "body_text")
    return TR.keep_filter(m.join(v, "id"), CFG).drop("relevance_score")


def items(fx: Fixtures) -> DataFrame:
    return X.extract_items(kept_messages(fx), fx.pages(), CFG)


@register("lookup_page", O.compose(EXTRACT_CTES, "SELECT id, link_url, article FROM art"))
def q_lookup_page(fx: Fixtures) -> DataFrame:
    """Crawled page text behind the best link of each kept high-relevance message."""
    return X.lookup_page(X.gated_links(kept_messages(fx)), fx.pages())


SQL_CRAWLED = ("crawled", """
SELECT page_id, url, html, CASE WHEN page_id % 17 = 5 THEN NULL WHEN page_id % 5 = 2 THEN 404 WHEN page_id % 5 = 4 THEN 204 ELSE 200 END AS status,
       CASE WHEN page_id % 13 = 1 THEN NULL WHEN page_id % 7 = 3 THEN 'application/pdf' WHEN page_id % 2 = 0 THEN 'text/html; charset=utf-8'
            ELSE 'application/xhtml+xml' END AS content_type FROM pages""")


def crawled_pages(fx: Fixtures) -> DataFrame:
    """Stand-in for a crawl log: the pages with a status and a content type."""
    p = F.col("page_id")
    return fx.pages().select(
        "page_id", "url", "html", F.when(p % 17 == 5, None).when(p % 5 == 2, 404).when(p % 5 == 4, 204).otherwise(200).alias("status"),
        F.when(p % 13 == 1, None).when(p % 7 == 3, "application/pdf").when(p % 2 == 0, "text/html; charset=utf-8")
        .otherwise("application/xhtml+xml").alias("content_type"))


@register("lookup_fetched_page", O.compose([
    SQL_KEPT_M, SQL_HIGH, *O.best_link_ctes("hl", "high_m"), SQL_CRAWLED,
    ("pg", """SELECT url, arg_min(html, page_id) AS html FROM crawled
              WHERE status // 100 = 2 AND position('html' IN content_type) > 0 GROUP BY url"""), SQL_ART],
    "SELECT id, link_url, article FROM art"))
def q_lookup_fetched_page(fx: Fixtures) -> DataFrame:
    """The lookup over pages that carry a status and a content type; failed fetches and other types give ''."""
    return X.lookup_page(X.gated_links(kept_messages(fx)), crawled_pages(fx))


@register("combine_article", O.compose(EXTRACT_CTES, "SELECT id, full_content FROM items"))
def q_combine_article(fx: Fixtures) -> DataFrame:
    """body plus the linked article (when non-empty) for every kept message."""
    return items(fx).select(F.col("email_id").alias("id"), "full_content")


@register("over_budget", O.compose([*EXTRACT_CTES, SQL_TOK],
    f"SELECT id, len(t) AS n_tokens, len(t) > {WCFG.token_budget} AS over FROM tok"))
def q_over_budget(fx: Fixtures) -> DataFrame:
    """Combined text strictly over the token budget (of 200, which most texts exceed)."""
    t = items(fx).select(F.col("email_id").alias("id"), T.token_count("full_content").cast("long").alias("n_tokens"))
    return t.select("id", "n_tokens", (F.col("n_tokens") > WCFG.token_budget).alias("over"))


def windows(fx: Fixtures) -> DataFrame:
    tok = fx.messages().select("id", T.word_pieces("body_text").alias("t"))
    w = tok.select("id", F.inline(X.token_windows(F.col("t"), WCFG.token_budget, WCFG.window_stride)))
    return w.select("id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"),
                    "chunk_text")


@register("token_windows", O.compose([SQL_WTOK, SQL_WINDOWS], "SELECT id, chunk_no, start, chunk_text FROM windows"))
def q_token_windows(fx: Fixtures) -> DataFrame:
    """Overlapping windows (size 200, stride 150) over every message text."""
    return windows(fx).select("id", "chunk_no", "start", "chunk_text")


SQL_SUMMARIES = ("summaries", f"""
SELECT id, chunk_no, CASE WHEN length(chunk_text) % 7 = 0 THEN concat(substr(chunk_text, 1, {K.CHUNK_FALLBACK_CHARS}), '...')
                          ELSE concat(length(chunk_text), ' characters: ', substr(chunk_text, 1, 40)) END AS summary
FROM windows""")


@register("summarize_chunks", O.compose([SQL_WTOK, SQL_WINDOWS, SQL_SUMMARIES], "SELECT id, chunk_no, summary FROM summaries"))
def q_summarize_chunks(fx: Fixtures) -> DataFrame:
    """U4: every window summarised by a model callable; a call that fails gives the window's fallback."""
    return summaries(fx)


def summaries(fx: Fixtures) -> DataFrame:
    return X.summarize_windows(windows(fx), lead_model).select("id", F.col("chunk_no").cast("long").alias("chunk_no"), "summary")


@register("join_summaries", O.compose([SQL_WTOK, SQL_WINDOWS, SQL_SUMMARIES], f"""
SELECT s.id, string_agg(s.summary, chr(10) || chr(10) ORDER BY s.chunk_no) AS summary_text
FROM summaries s JOIN wtok w ON w.id = s.id WHERE len(w.t) > {WCFG.token_budget} GROUP BY s.id"""))
def q_join_summaries(fx: Fixtures) -> DataFrame:
    """The model's window summaries of every over-budget text, regrouped in window order."""
    tok = fx.messages().select("id", T.word_pieces("body_text").alias("t")).where(F.size("t") > WCFG.token_budget)
    w = tok.select("id", F.inline(X.token_windows(F.col("t"), WCFG.token_budget, WCFG.window_stride)))
    return X.join_summaries(X.summarize_windows(w, lead_model))


# every thirteenth message has no body at all: its extraction gives nothing
SQL_BARE = [(name, sql.replace("m.body_html, m.body_text", "CASE WHEN m.ord % 13 = 0 THEN '' ELSE m.body_html END AS body_html, "
                                                           "CASE WHEN m.ord % 13 <> 0 THEN m.body_text END AS body_text"))
            for name, sql in [*EXTRACT_CTES, SQL_TOK]]


@register("union_fallback", O.compose(SQL_BARE,
    f"""SELECT id AS email_id, ord, {O.source_name('sender')} AS source_name,
               array_to_string(topics, '|') AS topics, category,
               CASE WHEN t IS NULL THEN snippet WHEN len(t) > {CFG.token_budget}
                    THEN {O.chunked_fallback_summary('t', CFG.token_budget, CFG.window_stride)}
                    ELSE full_content END AS summary_text,
               link_url, coalesce(full_content, '') AS full_content, subject AS email_subject
        FROM tok"""))
def q_union_fallback(fx: Fixtures) -> DataFrame:
    """The extracted items of every kept message; those without a body fall back to their snippet."""
    bare = F.col("ord") % 13 == 0
    kept = kept_messages(fx).withColumns({"body_html": F.when(bare, F.lit("")).otherwise(F.col("body_html")),
                                          "body_text": F.when(~bare, F.col("body_text"))})
    return X.extract_items(kept, fx.pages(), CFG).select(
        "email_id", "ord", "source_name", F.array_join("topics", "|").alias("topics"),
        "category", "summary_text", "link_url", "full_content", "email_subject")
