"""Registered digest queries (F14, A7, W3, F16-F19, F22, A8) over the extracted items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions.templates import sql_fill
from sifter.operators import digest as D
from sifter.operators import extract as X
from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.plans.q_extract import EXTRACT_CTES, SQL_TOK, items, kept_messages
from sifter.sources.fixtures import EPOCH0, Fixtures

N = CFG.max_synthesis_items
SQL_PRIO = "CASE category WHEN 'high_relevance' THEN 0 WHEN 'general_info' THEN 1 ELSE 2 END"
SQL_ITEMS_F = ("items_f", f"""
SELECT id AS email_id, ord, {O.source_name('sender')} AS source_name, topics, category,
       CASE WHEN len(t) > {CFG.token_budget} THEN {O.chunked_fallback_summary('t', CFG.token_budget, CFG.window_stride)}
            ELSE full_content END AS summary_text,
       link_url, full_content, subject AS email_subject, {SQL_PRIO} AS priority
FROM tok""")
SQL_CAPPED = ("capped_i", f"SELECT * FROM items_f ORDER BY priority, ord LIMIT {N}")
ITEM_CTES = [*EXTRACT_CTES, SQL_TOK, SQL_ITEMS_F]


def sql_item_block() -> str:
    topics = f"CASE WHEN coalesce(len(topics), 0) > 0 THEN array_to_string(topics, ', ') ELSE {O.q(K.ITEM_NO_TOPICS)} END"
    return sql_fill(K.SYNTHESIS_ITEM_TEMPLATE, source="source_name", topics=topics, category="coalesce(category, 'None')",
                    content=O.truncate_ellipsis('summary_text', K.ITEM_CONTENT_CHARS),
                    link=f"coalesce(link_url, {O.q(K.ITEM_NO_LINK)})")


def sql_fallback_line() -> str:
    return (f"concat('- **', source_name, '**: ', substr(summary_text, 1, {K.FALLBACK_BULLET_CHARS}), "
            f"CASE WHEN coalesce(link_url, '') <> '' THEN concat(' — [link](', link_url, ')') ELSE '' END)")


def sql_bullet() -> str:
    return (f"concat('- [', CASE WHEN coalesce(email_subject, '') <> '' THEN email_subject ELSE source_name END, "
            f"'](', {O.q(K.MAIL_DEEP_LINK)}, email_id, ') — *', source_name, '*')")


SQL_FALLBACK = ("fb", f"""
SELECT count(*) AS n_items,
       CASE WHEN count(*) = 0 THEN {O.q(K.EMPTY_DIGEST)}
            ELSE concat({O.q(K.FALLBACK_HEADER + chr(10))}, string_agg({sql_fallback_line()}, chr(10) ORDER BY priority, ord))
       END AS fallback_md
FROM capped_i""")
SQL_SOURCES = ("src", f"""
SELECT count(*) AS n_sources,
       CASE WHEN count(*) = 0 THEN '' ELSE concat({O.q(K.SOURCES_HEADER + chr(10))},
            string_agg({sql_bullet()}, chr(10) ORDER BY priority, ord)) END AS sources_md
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY priority, ord) AS r
                     FROM capped_i WHERE coalesce(email_id, '') <> '') WHERE r = 1)""")


def headers(fx: Fixtures) -> DataFrame:
    """The item columns that need no extraction, with their priority."""
    return X.item_headers(kept_messages(fx)).withColumn("priority", D.priority("category"))


def prioritized(fx: Fixtures) -> DataFrame:
    return items(fx).withColumn("priority", D.priority("category"))


def capped(fx: Fixtures) -> DataFrame:
    return D.capped_items(kept_messages(fx), fx.pages(), CFG)


@register("item_block", O.compose(ITEM_CTES, f"SELECT email_id, {sql_item_block()} AS block FROM items_f"))
def q_item_block(fx: Fixtures) -> DataFrame:
    """synthesis block of every extracted item."""
    return items(fx).select("email_id", D.item_block("source_name", "topics", "category", "summary_text",
                                                     "link_url").alias("block"))


@register("digest_items_block", O.compose([*ITEM_CTES, SQL_CAPPED],
    f"""SELECT count(*) AS n_items, string_agg({sql_item_block()}, chr(10) ORDER BY priority, ord) AS items_block
        FROM capped_i"""))
def q_digest_items_block(fx: Fixtures) -> DataFrame:
    """The capped items' blocks joined in priority order (the synthesis prompt body)."""
    return D.digest_items_block(capped(fx))


SQL_KEYED = ("keyed", """
SELECT CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 11 = 1 THEN NULL ELSE CAST(ord // 7 AS VARCHAR) END AS email_id, ord, source_name,
       email_subject, priority FROM items_f""")


def keyed(fx: Fixtures) -> DataFrame:
    """The items under shared email ids (seven messages each), some empty or missing."""
    o = F.col("ord")
    return headers(fx).withColumn("email_id", F.when(o % 11 == 0, F.lit("")).when(o % 11 != 1, F.floor(o / 7).cast("string")))


@register("first_per_key", O.compose([*ITEM_CTES, SQL_KEYED],
    """SELECT email_id, source_name, email_subject FROM (
         SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY priority, ord) AS r
         FROM keyed WHERE coalesce(email_id, '') <> '') WHERE r = 1"""))
def q_first_per_key(fx: Fixtures) -> DataFrame:
    """W3 + P9: first item per non-empty email id in priority order."""
    return D.first_per_key(keyed(fx)).select("email_id", "source_name", "email_subject")


@register("nonempty_id", O.compose([*ITEM_CTES, SQL_KEYED],
    "SELECT email_id, ord FROM keyed WHERE coalesce(email_id, '') <> ''"))
def q_nonempty_id(fx: Fixtures) -> DataFrame:
    """Items with an empty email id never reach the sources list."""
    return keyed(fx).where(F.coalesce(F.col("email_id"), F.lit("")) != "").select("email_id", "ord")


@register("source_bullet", O.compose([*ITEM_CTES, SQL_CAPPED, SQL_SOURCES], "SELECT n_sources, sources_md FROM src"))
def q_source_bullet(fx: Fixtures) -> DataFrame:
    """F16: the sources section over the capped items ('' when empty)."""
    return D.sources_section(capped(fx))


@register("fallback_digest", O.compose([*ITEM_CTES, SQL_CAPPED, SQL_FALLBACK], "SELECT n_items, fallback_md FROM fb"))
def q_fallback_digest(fx: Fixtures) -> DataFrame:
    """the bullet-list digest used when the synthesis model fails."""
    return D.fallback_digest(capped(fx))


@register("append_sources", O.compose([*ITEM_CTES, SQL_CAPPED, SQL_FALLBACK, SQL_SOURCES],
    """SELECT fb.n_items, CASE WHEN coalesce(src.sources_md, '') <> ''
                               THEN concat(fb.fallback_md, chr(10) || chr(10), src.sources_md)
                               ELSE fb.fallback_md END AS digest_md
       FROM fb, src"""))
def q_append_sources(fx: Fixtures) -> DataFrame:
    """digest text plus the sources section."""
    parts = D.digest_parts(capped(fx))                 # one pass over the capped items
    return parts.select("n_items", D.append_sources(F.col("fallback_md"), F.col("sources_md")).alias("digest_md"))


@register("digest_subject", O.compose([],
    f"""SELECT id, concat({O.q(K.SUBJECT_PREFIX)},
                          CASE WHEN hour(to_timestamp(received_epoch)) < {K.MORNING_BEFORE_HOUR}
                               THEN 'Morning' ELSE 'Evening' END,
                          ', ', strftime(to_timestamp(received_epoch), '%B %d, %Y')) AS subject_line
        FROM messages"""))
def q_digest_subject(fx: Fixtures) -> DataFrame:
    """the digest subject line a run at each message's arrival time would get (UTC)."""
    return fx.messages().select("id", D.digest_subject(F.col("received_epoch")).alias("subject_line"))


@register("topic_digest", O.compose([*ITEM_CTES,
    ("tp", f"""SELECT coalesce(tp, {O.q(K.ITEM_NO_TOPICS)}) AS topic, source_name, category
              FROM (SELECT unnest(CASE WHEN len(topics) > 0 THEN topics ELSE [NULL] END) AS tp, source_name, category
                    FROM items_f)"""),
    ("pairs", f"""SELECT topic, source_name, count(*) AS n_from_source,
                         count(*) FILTER (WHERE category = '{K.CATEGORY_HIGH}') AS h FROM tp GROUP BY topic, source_name"""),
    ("totals", """SELECT topic, CAST(sum(n_from_source) AS BIGINT) AS n_items, CAST(sum(h) AS BIGINT) AS n_high,
                        count(*) AS n_sources FROM pairs GROUP BY topic""")],
    f"""SELECT p.topic, p.source_name, p.n_from_source, t.n_items, t.n_high, t.n_sources,
               CASE WHEN t.n_items = 1 AND t.n_high = 0 THEN {O.q(K.QUICK_HITS)} ELSE p.topic END AS section
        FROM pairs p JOIN totals t ON t.topic = p.topic"""))
def q_topic_digest(fx: Fixtures) -> DataFrame:
    """Items grouped by topic and source with topic totals; single general items -> Quick Hits."""
    return D.topic_digest(headers(fx)).select("topic", "source_name", "n_from_source", "n_items", "n_high", "n_sources",
                                            "section")


RUN_SECONDS = 300


@register("empty_digest", O.compose([*ITEM_CTES,
    ("rl", f"SELECT DISTINCT (received_epoch - {EPOCH0}) // {RUN_SECONDS} AS run_id FROM messages"),
    ("ri", f"""SELECT (m.received_epoch - {EPOCH0}) // {RUN_SECONDS} AS run_id, i.*
               FROM items_f i JOIN messages m ON m.id = i.email_id"""),
    ("rc", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority, ord) AS rr FROM ri)
               WHERE rr <= {N}""")],
    f"""SELECT rl.run_id, count(rc.email_id) AS n_items,
               CASE WHEN count(rc.email_id) = 0 THEN {O.q(K.EMPTY_DIGEST)}
                    ELSE concat({O.q(K.FALLBACK_HEADER + chr(10))},
                                string_agg({sql_fallback_line()}, chr(10) ORDER BY rc.priority, rc.ord)) END AS digest_md
        FROM rl LEFT JOIN rc ON rc.run_id = rl.run_id GROUP BY rl.run_id"""))
def q_empty_digest(fx: Fixtures) -> DataFrame:
    """with a run every five minutes, the fallback digest of the items that arrived in each run's
    interval; a run without a new item gets the fixed empty digest."""
    run = F.floor((F.col("received_epoch") - EPOCH0) / RUN_SECONDS).alias("run_id")
    log = fx.messages().select(run).distinct()
    it = prioritized(fx).join(fx.messages().select(F.col("id").alias("email_id"), run), "email_id")
    rw = Window.partitionBy("run_id").orderBy("priority", "ord")
    capped_runs = it.withColumn("_r", F.row_number().over(rw)).where(F.col("_r") <= N)
    per_run = capped_runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        D.ordered_text(D.fallback_line("source_name", "summary_text", "link_url"), F.struct("priority", "ord"),
                       "\n").alias("_lines"))
    j = log.join(per_run, "run_id", "left")
    n = F.coalesce(F.col("n_items"), F.lit(0))
    return j.select("run_id", n.alias("n_items"),
                    F.when(n == 0, F.lit(K.EMPTY_DIGEST))
                    .otherwise(F.concat(F.lit(K.FALLBACK_HEADER + "\n"), F.col("_lines"))).alias("digest_md"))
