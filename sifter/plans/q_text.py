"""Registered scalar text queries (F1-F5, F9, F10, F20, F21, T3) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions import html as H
from sifter.functions import text as T
from sifter.plans import oracle as O
from sifter.plans.catalog import register
from sifter.sources.fixtures import Fixtures


@register("normalize_sender", O.compose([],
    f"SELECT id, sender, {O.normalize_sender('sender')} AS sender_key FROM messages"))
def q_normalize_sender(fx: Fixtures) -> DataFrame:
    """canonical sender key of every message."""
    return fx.messages().select("id", "sender", T.normalize_sender("sender").alias("sender_key"))


@register("source_name", O.compose([],
    f"SELECT id, sender, {O.source_name('sender')} AS source_name FROM messages"))
def q_source_name(fx: Fixtures) -> DataFrame:
    """display name of every sender."""
    return fx.messages().select("id", "sender", T.source_name("sender").alias("source_name"))


SQL_MARKED = ("marked", """
SELECT id, CASE ord % 3 WHEN 0 THEN replace(body_text, ' ', concat(' ', chr(8203)))
                        WHEN 1 THEN concat(chr(65279), replace(body_text, 'e', concat('e', chr(173), chr(160)))) ELSE body_text END AS body
FROM messages""")


@register("strip_invisible", O.compose([SQL_MARKED],
    f"""SELECT id, length(body) - length({O.strip_invisible('body')}) AS n_removed,
               {O.strip_invisible('body')} AS clean_text FROM marked"""))
def q_strip_invisible(fx: Fixtures) -> DataFrame:
    """invisible code points deleted from every message text; two thirds of the texts are given some
    (zero-width spaces, byte order marks, soft hyphens, no-break spaces)."""
    o, text = F.col("ord"), F.col("body_text")
    marked = (F.when(o % 3 == 0, F.replace(text, F.lit(" "), F.lit(" \u200b")))
              .when(o % 3 == 1, F.concat(F.lit("\ufeff"), F.replace(text, F.lit("e"), F.lit("e\u00ad\u00a0")))).otherwise(text))
    m = fx.messages().select("id", marked.alias("body")).select("id", "body", T.strip_invisible("body").alias("clean_text"))
    return m.select("id", (F.length("body") - F.length("clean_text")).cast("long").alias("n_removed"), "clean_text")


@register("html_to_text", O.compose([],
    f"SELECT id, {O.html_to_text('body_html')} AS text FROM messages WHERE body_html <> ''"))
def q_html_to_text(fx: Fixtures) -> DataFrame:
    """plain text of every HTML body."""
    return (fx.messages().where(F.col("body_html") != "")
            .select("id", H.html_to_text("body_html").alias("text")))


@register("main_content", O.compose([],
    f"SELECT page_id, url, {O.main_content('html')} AS content FROM pages"))
def q_main_content(fx: Fixtures) -> DataFrame:
    """main article text of every crawled page."""
    return fx.pages().select("page_id", "url", H.main_content("html").alias("content"))


@register("preview_text", O.compose([],
    f"SELECT id, {O.preview_text('snippet', 'body_text')} AS preview FROM messages"))
def q_preview_text(fx: Fixtures) -> DataFrame:
    """triage preview (snippet, else body text; 600 characters)."""
    return fx.messages().select("id", T.preview_text("snippet", "body_text").alias("preview"))


@register("choose_body", O.compose([],
    f"""SELECT id, CASE WHEN body_html <> '' THEN {O.html_to_text('body_html')} ELSE body_text END AS body
        FROM messages"""))
def q_choose_body(fx: Fixtures) -> DataFrame:
    """stripped HTML when there is HTML, else the raw text unstripped."""
    return fx.messages().select(
        "id", F.when(F.col("body_html") != "", H.html_to_text("body_html")).otherwise(F.col("body_text")).alias("body"))


@register("token_count", O.compose([],
    f"SELECT id, len({O.word_pieces('body_text')}) AS n_tokens FROM messages"))
def q_token_count(fx: Fixtures) -> DataFrame:
    """word-piece count of every message text."""
    return fx.messages().select("id", T.token_count("body_text").cast("long").alias("n_tokens"))


@register("token_slice_text", O.compose([("tok", f"SELECT id, body_text, {O.word_pieces('body_text')} AS t FROM messages")],
    """SELECT id, array_to_string(list_slice(t, 1, 200), '') AS head_text,
              array_to_string(t, '') = body_text AS lossless FROM tok"""))
def q_token_slice_text(fx: Fixtures) -> DataFrame:
    """first 200 word pieces decoded back to text; decoding all pieces is lossless."""
    tok = fx.messages().select("id", "body_text", T.word_pieces("body_text").alias("t"))
    return tok.select("id", T.token_slice_text("t", 0, 200).alias("head_text"),
                      (F.array_join("t", "") == F.col("body_text")).alias("lossless"))


@register("truncate_text", O.compose([],
    f"""SELECT id, substr(body_text, 1, {K.PREVIEW_CHARS}) AS cap_preview,
               substr(body_text, 1, {K.ARTICLE_CHARS}) AS cap_article,
               {O.truncate_ellipsis('body_text', K.ITEM_CONTENT_CHARS)} AS cap_item,
               {O.truncate_ellipsis('body_text', K.CHUNK_FALLBACK_CHARS, always=True)} AS cap_chunk,
               substr(body_text, 1, {K.FALLBACK_BULLET_CHARS}) AS cap_bullet,
               substr(snippet, 1, {K.LISTING_SNIPPET_CHARS}) AS cap_listing
        FROM messages"""))
def q_truncate_text(fx: Fixtures) -> DataFrame:
    """Every character cap of the reference, code-point based."""
    b = F.col("body_text")
    return fx.messages().select(
        "id", T.truncate(b, K.PREVIEW_CHARS).alias("cap_preview"), T.truncate(b, K.ARTICLE_CHARS).alias("cap_article"),
        T.truncate_ellipsis(b, K.ITEM_CONTENT_CHARS).alias("cap_item"),
        T.truncate_ellipsis(b, K.CHUNK_FALLBACK_CHARS, always=True).alias("cap_chunk"),
        T.truncate(b, K.FALLBACK_BULLET_CHARS).alias("cap_bullet"),
        T.truncate(F.col("snippet"), K.LISTING_SNIPPET_CHARS).alias("cap_listing"))
