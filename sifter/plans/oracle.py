"""DuckDB SQL used as the independent oracle for every registered query.

The driver runs these strings in DuckDB over the raw parquet tables; each one
starts from the same fixture views (FIXTURES.md §3) and recomputes the
operator's answer with DuckDB's own functions.  Regex patterns are shared
text (``\\x{..}`` escapes read the same in Java and RE2); everything else is
independent SQL.
"""

from __future__ import annotations

from sifter.functions import constants as K
from sifter.functions import links as L
from sifter.functions import text as T


def q(s: str) -> str:
    """SQL string literal (no backslash processing in DuckDB)."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# fixture views
# ---------------------------------------------------------------------------

FIXTURE_CTES: list[tuple[str, str]] = [
    ("fx_n", "SELECT count(*) AS n FROM pages"),
    ("fx_lk", """
  SELECT d.doc_id, p0.html,
    concat('<p><a href="', CASE WHEN d.doc_id % 3 = 1 THEN 'https://example.com/' ELSE p1.url END, '">',
           CASE WHEN d.doc_id % 3 = 2 THEN 'open' ELSE 'Read the full analysis' END, '</a>',
           '<a href="', p2.url, '">here</a>',
           '<a href="https://medium.com/p/', cast(d.doc_id AS varchar), '">more</a>',
           '<a href="https://links.beehiiv.com/a/b">sponsored placement</a>',
           '<a href="https://example.com/unsubscribe?u=1">unsubscribe from this</a></p></article>') AS links
  FROM documents d CROSS JOIN fx_n n
  JOIN pages p0 ON p0.page_id = d.doc_id % n.n
  JOIN pages p1 ON p1.page_id = (d.doc_id * 7 + 1) % n.n
  JOIN pages p2 ON p2.page_id = (d.doc_id * 7 + 14) % n.n"""),
    ("messages", """
SELECT cast(d.doc_id AS varchar) AS id, d.doc_id AS ord,
  replace(substr(d.text, 1, 80), chr(10), ' ') AS subject,
  CASE d.doc_id % 4 WHEN 0 THEN concat('"', d.source, ' Daily" <', upper(d.source), '@example.com>')
    WHEN 1 THEN concat(d.source, ' Weekly <', d.source, '@example.com>')
    WHEN 2 THEN concat(d.source, '@example.com')
    ELSE concat('<', d.source, '@example.com>') END AS sender,
  1704067200 + d.doc_id * 60 AS received_epoch,
  split(concat_ws(',', 'UPDATES', CASE WHEN d.doc_id % 3 <> 0 THEN 'UNREAD' END,
                  CASE WHEN d.doc_id % 5 <> 0 THEN 'IMPORTANT' END), ',') AS label_ids,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE replace(substr(d.text, 1, 200), chr(10), ' ') END AS snippet,
  CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE replace(lk.html, '</article>', lk.links) END AS body_html,
  d.text AS body_text
FROM documents d JOIN fx_lk lk ON lk.doc_id = d.doc_id"""),
    ("verdicts", """
SELECT cast(d.doc_id AS varchar) AS id, d.doc_id AS ord,
  CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 'discard'
       WHEN l.quality = 1 THEN 'high_relevance' ELSE 'general_info' END AS category,
  CASE WHEN l.doc_id IS NULL THEN cast(0 AS double)
       ELSE cast(d.n_chars % 101 AS double) / 100 END AS relevance_score,
  split(concat_ws(',', d.lang, CASE WHEN d.doc_id % 2 = 0 THEN d.source END), ',') AS topics,
  CASE WHEN l.doc_id IS NULL THEN 'missing from model output' ELSE 'labelled' END AS reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    ("processed_messages", """
SELECT cast(doc_id AS varchar) AS message_id, 1704067200 + doc_id * 60 AS processed_epoch
FROM documents WHERE doc_id % 7 = 0"""),
    ("runs", """
SELECT CAST(id AS BIGINT) AS id, CAST(ran_epoch AS BIGINT) AS ran_epoch,
       CAST(messages_processed AS BIGINT) AS messages_processed
FROM (VALUES (1, 1704067200, 120), (2, 1704085200, 0), (3, 1704081600, 57)) AS r(id, ran_epoch, messages_processed)"""),
]


def compose(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    """Fixture CTEs + operator CTEs + final SELECT as one statement."""
    parts = [f"{name} AS ({body.strip()})" for name, body in [*FIXTURE_CTES, *ctes]]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + final.strip()


# ---------------------------------------------------------------------------
# expression twins (DuckDB dialect)
# ---------------------------------------------------------------------------


def rx_replace(x: str, pattern: str, repl_sql: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {repl_sql}, 'g')"


def py_strip(x: str) -> str:
    return rx_replace(x, T.STRIP_PATTERN)


def normalize_sender(s: str) -> str:
    inner = f"regexp_extract({s}, {q(T.SENDER_ADDRESS_PATTERN)}, 1)"
    return py_strip(f"lower(CASE WHEN {inner} <> '' THEN {inner} ELSE {s} END)")


def source_name(s: str) -> str:
    pat = q(T.SOURCE_NAME_PATTERN)
    return (f"(CASE WHEN regexp_matches({s}, {pat}) THEN {py_strip(f'regexp_extract({s}, {pat}, 1)')} "
            f"ELSE split_part({s}, '@', 1) END)")


def strip_invisible(x: str) -> str:
    return rx_replace(x, T.INVISIBLE_CLASS)


def preview_text(snippet: str, body: str) -> str:
    return (f"substr(CASE WHEN coalesce({snippet}, '') <> '' THEN {snippet} "
            f"ELSE substr({body}, 1, {K.PREVIEW_CHARS}) END, 1, {K.PREVIEW_CHARS})")


def truncate_ellipsis(x: str, n: int, always: bool = False) -> str:
    cut = f"concat(substr({x}, 1, {n}), '...')"
    return cut if always else f"(CASE WHEN length({x}) > {n} THEN {cut} ELSE {x} END)"


# The oracle's own reading of HTML: its patterns and its small table of references are written here, not
# taken from the operators.  Every reference that stands in the tables is covered.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"),
            ("&euro;", "€"), ("&eacute;", "é")]
QUOTED = """(?:[^>"']|"[^"]*"|'[^']*')*"""
TAG = f"</?[A-Za-z]{QUOTED}>|</?[A-Za-z][^>]*>|<![^>]*>|<[?][^>]*>"


def decode_entities(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def drop_blocks(x: str, tags: list[str]) -> str:
    parts = ["<!--(?:.*?-->|.*)"] + [f"<{t}\\b{QUOTED}>(?:.*?</{t}\\s*>|.*)" for t in tags]
    return rx_replace(x, f"(?is)(?:{'|'.join(parts)})", "chr(1)")


def text_nodes_joined(x: str, sep_sql: str) -> str:
    nodes = f"list_transform(string_split({rx_replace(x, f'(?s){TAG}', 'chr(1)')}, chr(1)), lambda p: {py_strip(decode_entities('p'))})"
    return f"array_to_string(list_filter({nodes}, lambda p: p <> ''), {sep_sql})"


def html_to_text(x: str) -> str:
    t = strip_invisible(text_nodes_joined(drop_blocks(x, ["script", "style", "head"]), "chr(10)"))
    return py_strip(rx_replace(t, "\\n{3,}", "chr(10) || chr(10)"))


def main_content(x: str) -> str:
    cleaned = drop_blocks(x, ["script", "style", "nav", "footer", "header", "aside", "iframe"])
    branches = " ".join(
        f"WHEN regexp_matches({cleaned}, '(?is)<{t}\\b') "
        f"THEN regexp_extract({cleaned}, {q(f'(?is)<{t}{chr(92)}b{QUOTED}>(.*?)(?:</{t}{chr(92)}s*>|{chr(92)}z)')}, 1)"
        for t in ("article", "main", "body"))
    chosen = f"(CASE {branches} ELSE {drop_blocks(cleaned, ['head'])} END)"
    t = rx_replace(text_nodes_joined(chosen, "chr(10)"), "\\n{3,}", "chr(10) || chr(10)")
    return strip_invisible(f"substr({t}, 1, {K.ARTICLE_CHARS})")


ANCHOR = f"(?is)<a\\s{QUOTED}>.*?</a\\s*>"
HREF = """(?is)\\shref\\s*=\\s*(?:"([^"]*)"|'([^']*)'|([^\\s"'>]+))"""


def anchors(x: str) -> str:
    found = f"regexp_extract_all(coalesce({drop_blocks(x, ['script', 'style'])}, ''), {q(ANCHOR)}, 0)"
    return f"list_filter({found}, lambda a: regexp_matches(a, {q('(?is)^<a[^>]*' + chr(92) + 'shref' + chr(92) + 's*=')}))"


def anchor_href(a: str) -> str:
    open_tag = f"regexp_extract({a}, {q(f'(?is)^<a{chr(92)}s{QUOTED}>')}, 0)"
    raw = " || ".join(f"regexp_extract({open_tag}, {q(HREF)}, {g})" for g in (1, 2, 3))
    return py_strip(decode_entities(f"({raw})"))


def anchor_text(a: str) -> str:
    inner = f"regexp_extract({a}, {q(f'(?is)^<a{chr(92)}s{QUOTED}>(.*)</a{chr(92)}s*>$')}, 1)"
    return text_nodes_joined(inner, "''")


def url_netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(L.URL_PATTERN)}, 1))"


def url_path(u: str) -> str:
    return rx_replace(f"regexp_extract({u}, {q(L.URL_PATTERN)}, 2)", L.PARAMS_PATTERN)


def path_segments(p: str) -> str:
    return f"len(list_filter(string_split({p}, '/'), lambda s: s <> ''))"


def skip_by_pattern(u: str) -> str:
    return f"regexp_matches({u}, {q(L.SKIP_PATTERN)})"


def skip_by_domain(n: str) -> str:
    return "(" + " OR ".join(f"contains({n}, {q(d)})" for d in K.LINK_SKIP_DOMAINS) + ")"


def bad_netloc(n: str) -> str:
    return f"(contains({n}, '[') <> contains({n}, ']'))"


def score_link(u: str, a: str) -> str:
    n = url_netloc(u)
    host = " OR ".join(f"contains({n}, {q(d)})" for d in K.ARTICLE_DOMAINS)
    score = (f"(CAST({K.LINK_BASE_SCORE} AS DOUBLE)"
             f" + CASE WHEN coalesce(length({a}), 0) > {K.LINK_ANCHOR_MIN_CHARS} "
             f"THEN CAST({K.LINK_ANCHOR_BONUS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
             f" + CASE WHEN {path_segments(url_path(u))} >= {K.LINK_MIN_SEGMENTS} "
             f"THEN CAST({K.LINK_DEPTH_BONUS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
             f" + CASE WHEN {host} THEN CAST({K.LINK_DOMAIN_BONUS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
    return (f"(CASE WHEN {skip_by_pattern(u)} OR {skip_by_domain(n)} OR {bad_netloc(n)} "
            f"THEN CAST(0 AS DOUBLE) ELSE {score} END)")


def keep_flag(cat: str, score: str, thr: float) -> str:
    return (f"(coalesce({cat} <> 'discard', true) AND coalesce({score} >= {thr} AND NOT isnan({score}), false))")


def word_pieces(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.TOKEN_PATTERN)}, 0)"


def best_link_ctes(prefix: str, source: str, html_col: str = "body_html") -> list[tuple[str, str]]:
    """anchors -> web links -> scores -> argmax per id, over ``source(id, <html_col>)``."""
    return [
        (f"{prefix}_anchors", f"""
SELECT id, pos, {anchor_href('anchor')} AS href, {anchor_text('anchor')} AS anchor_text
FROM (SELECT id, unnest(a) AS anchor, generate_subscripts(a, 1) - 1 AS pos
      FROM (SELECT id, {anchors(html_col)} AS a FROM {source}))"""),
        (f"{prefix}_web", f"SELECT * FROM {prefix}_anchors WHERE regexp_matches(href, '^https?://')"),
        (f"{prefix}_scored", f"SELECT id, pos, href, {score_link('href', 'anchor_text')} AS score FROM {prefix}_web"),
        (f"{prefix}_best", f"""SELECT id, arg_max(href, (score, -pos)) AS link_url
                               FROM {prefix}_scored WHERE score > 0 GROUP BY id"""),
    ]


def chunked_fallback_summary(tokens: str, budget: int, stride: int) -> str:
    wins = (f"list_transform(generate_series(0, len({tokens}) - 1, {stride}), "
            f"lambda p: array_to_string(list_slice({tokens}, p + 1, p + {budget}), ''))")
    return (f"array_to_string(list_transform({wins}, lambda w: concat(substr(w, 1, {K.CHUNK_FALLBACK_CHARS}), '...')), "
            f"chr(10) || chr(10))")
