"""Link expressions: scheme filter, URL parts, skip rules, score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions.html import anchor_href, anchor_text, anchors
from sifter.functions.text import _c

SCHEME_PATTERN = "^https?://"
SKIP_PATTERN = "(?i)(" + "|".join(K.LINK_SKIP_ALTERNATIVES) + ")"
URL_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
PARAMS_PATTERN = ";[^/]*$"


def is_web_link(href) -> Column:
    """(already stripped) href starts with http:// or https:// (case-sensitive)."""
    return _c(href).rlike(SCHEME_PATTERN)


def url_netloc(url) -> Column:
    """lower-cased network location."""
    return F.lower(F.regexp_extract(_c(url), URL_PATTERN, 1))


def url_path(url) -> Column:
    """path without ``;params``, query or fragment."""
    return F.regexp_replace(F.regexp_extract(_c(url), URL_PATTERN, 2), PARAMS_PATTERN, "")


def path_segments(path) -> Column:
    return F.size(F.filter(F.split(_c(path), "/"), lambda p: p != ""))


def skip_by_pattern(url) -> Column:
    """Any skip alternative found anywhere in the URL (case-insensitive)."""
    return _c(url).rlike(SKIP_PATTERN)


def skip_by_domain(netloc) -> Column:
    """P5: tracking / infrastructure host."""
    n = _c(netloc)
    out = F.lit(False)
    for d in K.LINK_SKIP_DOMAINS:
        out = out | n.contains(d)
    return out


def bad_netloc(netloc) -> Column:
    """Unbalanced IPv6 brackets: the URL cannot be parsed; the link scores 0."""
    n = _c(netloc)
    return n.contains("[") != n.contains("]")


def score_from_parts(url: Column, anchor_txt: Column, netloc: Column, path: Column) -> Column:
    """F8 on precomputed URL parts (so each regex runs once per link)."""
    score = (F.lit(K.LINK_BASE_SCORE)
             + F.when(F.coalesce(F.length(anchor_txt), F.lit(0)) > K.LINK_ANCHOR_MIN_CHARS, F.lit(K.LINK_ANCHOR_BONUS))
             .otherwise(F.lit(0.0))
             + F.when(path_segments(path) >= K.LINK_MIN_SEGMENTS, F.lit(K.LINK_DEPTH_BONUS)).otherwise(F.lit(0.0)))
    host_bonus = F.lit(False)
    for d in K.ARTICLE_DOMAINS:
        host_bonus = host_bonus | netloc.contains(d)
    score = score + F.when(host_bonus, F.lit(K.LINK_DOMAIN_BONUS)).otherwise(F.lit(0.0))
    skipped = skip_by_pattern(url) | skip_by_domain(netloc) | bad_netloc(netloc)
    return F.when(skipped, F.lit(0.0)).otherwise(score)


def score_link(url, anchor_txt) -> Column:
    """F8: 0 if skipped; else 0.5 (+0.3 anchor > 10 chars) (+0.2 >= 2 path parts) (+0.1 host).

    Summed as doubles in this order: 0.5+0.2+0.1 < 0.5+0.3.
    """
    u, a = _c(url), _c(anchor_txt)
    return score_from_parts(u, a, url_netloc(u), url_path(u))


def link_candidates(html) -> Column:
    """Array of struct(pos, href, anchor_text, score) for every web link, in document order."""
    parsed = F.transform(anchors(html), lambda a, i: F.struct(
        i.alias("pos"), anchor_href(a).alias("href"), anchor_text(a).alias("anchor_text")))
    web = F.filter(parsed, lambda x: is_web_link(x["href"]))
    parts = F.transform(web, lambda x: F.struct(
        x["pos"].alias("pos"), x["href"].alias("href"), x["anchor_text"].alias("anchor_text"),
        url_netloc(x["href"]).alias("netloc"), url_path(x["href"]).alias("path")))
    return F.transform(parts, lambda x: F.struct(
        x["pos"].alias("pos"), x["href"].alias("href"), x["anchor_text"].alias("anchor_text"),
        score_from_parts(x["href"], x["anchor_text"], x["netloc"], x["path"]).alias("score")))


def best_link(html) -> Column:
    """A3 within one row: highest score > 0; ties go to the first link in the document.

    ``array_max`` over struct(score, -pos, href) is the per-row argmax, so no
    explode and no shuffle are needed.
    """
    positive = F.filter(link_candidates(html), lambda x: x["score"] > 0)
    keyed = F.transform(positive, lambda x: F.struct(x["score"].alias("score"), (-x["pos"]).alias("neg_pos"),
                                                     x["href"].alias("href")))
    return F.array_max(keyed)["href"]
