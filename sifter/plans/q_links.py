"""Registered link queries (F6-F8, P3-P7, A3) over every message body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions import html as H
from sifter.functions import links as L
from sifter.operators import extract as X
from sifter.plans import oracle as O
from sifter.plans.catalog import register
from sifter.sources.fixtures import Fixtures

SQL_ANCHORS = ("anchors", f"""
SELECT id, pos, {O.anchor_href('anchor')} AS href, {O.anchor_text('anchor')} AS anchor_text
FROM (SELECT id, unnest(a) AS anchor, generate_subscripts(a, 1) - 1 AS pos
      FROM (SELECT id, {O.anchors('body_html')} AS a FROM messages))""")
SQL_WEB = ("web", "SELECT * FROM anchors WHERE regexp_matches(href, '^https?://')")
SQL_SCORED = ("scored", f"SELECT id, pos, href, {O.score_link('href', 'anchor_text')} AS score FROM web")
SQL_BEST = ("best", """SELECT id, arg_max(href, (score, -pos)) AS link_url
                       FROM scored WHERE score > 0 GROUP BY id""")


def anchors(fx: Fixtures) -> DataFrame:
    """Every anchor of every message body, in document order (pos is 0-based)."""
    a = fx.messages().select("id", F.posexplode(H.anchors("body_html")).alias("pos", "anchor"))
    return a.select("id", F.col("pos").cast("long").alias("pos"), H.anchor_href("anchor").alias("href"),
                    H.anchor_text("anchor").alias("anchor_text"))


def web(fx: Fixtures) -> DataFrame:
    return anchors(fx).where(L.is_web_link("href"))


@register("extract_anchors", O.compose([SQL_ANCHORS], "SELECT id, pos, href, anchor_text FROM anchors"))
def q_extract_anchors(fx: Fixtures) -> DataFrame:
    """all <a href> with their anchor text, in document order."""
    return anchors(fx)


@register("link_scheme_filter", O.compose([SQL_ANCHORS, SQL_WEB], "SELECT id, pos, href FROM web"))
def q_link_scheme_filter(fx: Fixtures) -> DataFrame:
    """Only absolute http(s) links survive."""
    return web(fx).select("id", "pos", "href")


@register("url_netloc_path", O.compose([SQL_ANCHORS, SQL_WEB],
    f"""SELECT id, pos, {O.url_netloc('href')} AS netloc, {O.url_path('href')} AS path,
               {O.path_segments(O.url_path('href'))} AS n_segments FROM web"""))
def q_url_netloc_path(fx: Fixtures) -> DataFrame:
    """lower-cased host, path without params/query/fragment, non-empty segment count."""
    return web(fx).select("id", "pos", L.url_netloc("href").alias("netloc"), L.url_path("href").alias("path"),
                          L.path_segments(L.url_path("href")).cast("long").alias("n_segments"))


@register("link_skip_pattern", O.compose([SQL_ANCHORS, SQL_WEB],
    f"SELECT id, pos, href, {O.skip_by_pattern('href')} AS skipped FROM web"))
def q_link_skip_pattern(fx: Fixtures) -> DataFrame:
    """Links matching a skip alternative score 0."""
    return web(fx).select("id", "pos", "href", L.skip_by_pattern("href").alias("skipped"))


@register("link_skip_domain", O.compose([SQL_ANCHORS, SQL_WEB],
    f"SELECT id, pos, {O.url_netloc('href')} AS netloc, {O.skip_by_domain(O.url_netloc('href'))} AS skipped FROM web"))
def q_link_skip_domain(fx: Fixtures) -> DataFrame:
    """P5: tracking hosts score 0."""
    w = web(fx).select("id", "pos", L.url_netloc("href").alias("netloc"))
    return w.select("id", "pos", "netloc", L.skip_by_domain("netloc").alias("skipped"))


@register("score_link", O.compose([SQL_ANCHORS, SQL_WEB, SQL_SCORED], "SELECT id, pos, href, score FROM scored"))
def q_score_link(fx: Fixtures) -> DataFrame:
    """F8: score of every web link."""
    return web(fx).select("id", "pos", "href", L.score_link("href", "anchor_text").alias("score"))


@register("positive_score", O.compose([SQL_ANCHORS, SQL_WEB, SQL_SCORED],
    "SELECT id, pos, href, score FROM scored WHERE score > 0"))
def q_positive_score(fx: Fixtures) -> DataFrame:
    """Candidates with score > 0."""
    s = web(fx).select("id", "pos", "href", L.score_link("href", "anchor_text").alias("score"))
    return s.where(F.col("score") > 0)


@register("best_link", O.compose([SQL_ANCHORS, SQL_WEB, SQL_SCORED, SQL_BEST], "SELECT id, link_url FROM best"))
def q_best_link(fx: Fixtures) -> DataFrame:
    """A3: argmax link per message (first in document order on ties), computed within each row."""
    return X.message_links(fx.messages())


@register("link_gate", O.compose([SQL_ANCHORS, SQL_WEB, SQL_SCORED, SQL_BEST],
    f"""SELECT b.id, b.link_url FROM best b JOIN verdicts v ON v.id = b.id
        WHERE v.category = '{K.CATEGORY_HIGH}'"""))
def q_link_gate(fx: Fixtures) -> DataFrame:
    """Links are only looked for in high-relevance messages (filter before the anchor work)."""
    high = fx.verdicts().where(F.col("category") == K.CATEGORY_HIGH).select("id")
    return X.message_links(fx.messages().select("id", "body_html").join(high, "id", "left_semi"))
