"""Registered state / incremental / sink queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.operators import state_ops as S
from sifter.operators import triage as TR
from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.plans.digest_run import run_digest
from sifter.plans.q_digest import sql_bullet, sql_fallback_line
from sifter.plans.q_extract import SQL_ART, SQL_BASE, SQL_HIGH, SQL_ITEMS, SQL_PG, SQL_TOK
from sifter.session import shared_folder
from sifter.sources import sinks
from sifter.sources.fixtures import Fixtures
from sifter.sources.keyed_state import KeyedState
from sifter.sources.state import append_processed, append_run, next_run_row, read_state

THR = CFG.triage_score_threshold
DAY = 86400

# The run happens one minute after the newest message arrived.
SQL_ASOF = ("run_at", "SELECT max(received_epoch) + 60 AS as_of FROM messages")
SQL_LAST = ("last_run", "SELECT arg_max(ran_epoch, id) AS last_ran_epoch FROM runs")
SQL_CUTOFF = ("cutoff", f"""
SELECT coalesce(l.last_ran_epoch, a.as_of - {CFG.initial_lookback_days * DAY}) AS cutoff_epoch,
       CASE WHEN l.last_ran_epoch IS NULL THEN 'initial_lookback' ELSE 'last_run' END AS cutoff_source
FROM last_run l, run_at a""")
SQL_FETCHED = ("fetched", """
SELECT m.* FROM messages m
WHERE list_contains(m.label_ids, 'UPDATES') AND list_contains(m.label_ids, 'UNREAD')
  AND list_contains(m.label_ids, 'IMPORTANT')
  AND m.received_epoch > (SELECT floor(cutoff_epoch) FROM cutoff)""")
SQL_FRESH = ("fresh", """SELECT f.* FROM fetched f
                         WHERE NOT EXISTS (SELECT 1 FROM processed_messages p WHERE p.message_id = f.id)""")
STATE_CTES = [SQL_ASOF, SQL_LAST, SQL_CUTOFF, SQL_FETCHED]


def as_of(fx: Fixtures):
    return fx.messages().select(F.max("received_epoch") + 60).scalar()


def fetched(fx: Fixtures) -> DataFrame:
    return S.scan_incremental(fx.messages(), S.resolve_cutoff(fx.runs(), as_of(fx), CFG), CFG)


SQL_EVENT_RUNS = ("event_runs", """
SELECT user_id AS id, CAST(floor(epoch(max(ts))) AS BIGINT) AS ran_epoch, count(*) AS messages_processed
FROM events GROUP BY user_id""")


def event_run_log(fx: Fixtures) -> DataFrame:
    """A run log derived from activity: one run per user, at its latest event."""
    return (fx.table("events").groupBy(F.col("user_id").alias("id"))
            .agg(F.unix_seconds(F.max("ts").cast("timestamp")).alias("ran_epoch"), F.count(F.lit(1)).alias("messages_processed")))


@register("last_run", O.compose([SQL_LAST, SQL_EVENT_RUNS], """
SELECT 'runs' AS log, last_ran_epoch FROM last_run
UNION ALL
SELECT 'events', arg_max(ran_epoch, id) FROM event_runs"""))
def q_last_run(fx: Fixtures) -> DataFrame:
    """A4: time of the run with the greatest id (not the latest time), for the
    fixture run log and for a run log derived from the events table."""
    return (S.last_run(fx.runs()).select(F.lit("runs").alias("log"), "last_ran_epoch")
            .unionByName(S.last_run(event_run_log(fx)).select(F.lit("events").alias("log"), "last_ran_epoch")))


@register("resolve_cutoff", O.compose([SQL_ASOF, SQL_LAST, SQL_CUTOFF, SQL_EVENT_RUNS], f"""
SELECT 'runs' AS log, cutoff_epoch, cutoff_source FROM cutoff
UNION ALL
SELECT 'events', arg_max(ran_epoch, id), 'last_run' FROM event_runs
UNION ALL
SELECT 'none', as_of - {CFG.initial_lookback_days * DAY}, 'initial_lookback' FROM run_at
UNION ALL
SELECT 'override', as_of - {2 * DAY}, 'override' FROM run_at"""))
def q_resolve_cutoff(fx: Fixtures) -> DataFrame:
    """Override -> last run -> initial lookback, for the fixture log, a log derived from the
    events table, an empty log, and an override."""
    log, out = event_run_log(fx), None
    override = replace(CFG, lookback_days_override=2)
    for name, runs, cfg in (("runs", fx.runs(), CFG), ("events", log, CFG), ("none", log.where("id IS NULL"), CFG),
                            ("override", log, override)):
        row = S.resolve_cutoff(runs, as_of(fx), cfg).select(F.lit(name).alias("log"), "cutoff_epoch", "cutoff_source")
        out = row if out is None else out.unionByName(row)
    return out


@register("scan_incremental", O.compose(STATE_CTES,
    "SELECT id, ord, subject, sender, received_epoch FROM fetched"))
def q_scan_incremental(fx: Fixtures) -> DataFrame:
    """Updates that are unread and important, received after the cutoff."""
    return fetched(fx).select("id", "ord", "subject", "sender", "received_epoch")


@register("anti_join_processed", O.compose([],
    """SELECT m.id, m.ord FROM messages m
       WHERE NOT EXISTS (SELECT 1 FROM processed_messages p WHERE p.message_id = m.id)"""))
def q_anti_join_processed(fx: Fixtures) -> DataFrame:
    """Messages whose id is not in a written state; only the buckets that may hold one are read."""
    return KeyedState(fx.spark, written_state(fx)).unseen(fx.messages().select("id", "ord"))


@register("new_vs_seen", O.compose(STATE_CTES,
    """SELECT count(*) FILTER (WHERE p.message_id IS NULL) AS n_new,
              count(*) FILTER (WHERE p.message_id IS NOT NULL) AS n_seen
       FROM fetched f LEFT JOIN processed_messages p ON p.message_id = f.id"""))
def q_new_vs_seen(fx: Fixtures) -> DataFrame:
    """A2: fetched messages that are new vs already processed, looked up in a written state."""
    ids = fetched(fx).select("id")
    known = KeyedState(fx.spark, written_state(fx)).known(ids)
    return S.new_vs_seen(ids, known.select(F.col("id").alias("message_id")))


def written_state(fx: Fixtures) -> str:
    """A new state folder that holds the processed ids and the event-derived run log, as run 0 left them."""
    folder = shared_folder(fx.spark, "state")
    KeyedState(fx.spark, folder).load(fx.processed_messages().withColumn("run_id", F.lit(0)), event_run_log(fx))
    return folder


def as_of_value(fx: Fixtures) -> int:
    return int(fx.messages().agg(F.max("received_epoch") + 60).first()[0])


@register("read_state", O.compose([SQL_EVENT_RUNS],
    """SELECT p.message_id, p.processed_epoch, (SELECT arg_max(ran_epoch, id) FROM event_runs) AS last_ran_epoch
       FROM processed_messages p"""))
def q_read_state(fx: Fixtures) -> DataFrame:
    """Processed ids together with the last run time, read from a written state folder."""
    processed, runs = read_state(fx.spark, written_state(fx))
    return processed.select("message_id", "processed_epoch", S.last_run(runs).scalar().alias("last_ran_epoch"))


@register("append_processed", O.compose(STATE_CTES,
    """SELECT message_id, processed_epoch FROM processed_messages
       UNION ALL
       SELECT DISTINCT f.id AS message_id, (SELECT as_of FROM run_at) AS processed_epoch FROM fetched f
       WHERE NOT EXISTS (SELECT 1 FROM processed_messages p WHERE p.message_id = f.id)"""))
def q_append_processed(fx: Fixtures) -> DataFrame:
    """This run's fetched ids written to a state folder (twice: a replay changes nothing), read back."""
    folder, now = written_state(fx), as_of_value(fx)
    ids = fetched(fx).select("id")
    append_processed(fx.spark, folder, ids, now, run_id=1)
    append_processed(fx.spark, folder, ids, now + 1, run_id=1)
    return read_state(fx.spark, folder)[0].select("message_id", "processed_epoch")


@register("append_run", O.compose([*STATE_CTES, SQL_FRESH, SQL_EVENT_RUNS],
    """SELECT id, ran_epoch, messages_processed FROM event_runs
       UNION ALL
       SELECT (SELECT max(id) FROM event_runs) + 1, (SELECT as_of FROM run_at), (SELECT count(*) FROM fresh)"""))
def q_append_run(fx: Fixtures) -> DataFrame:
    """This run's row written to a state folder, the log read back."""
    folder, now = written_state(fx), as_of_value(fx)
    runs, fresh = read_state(fx.spark, folder)[1], KeyedState(fx.spark, folder).unseen(fetched(fx).select("id"))
    row = next_run_row(runs, F.lit(now), fresh.select(F.count(F.lit(1))).scalar()).first()
    append_run(fx.spark, folder, now, row["messages_processed"], row["id"])
    return read_state(fx.spark, folder)[1].select("id", "ran_epoch", "messages_processed")


SQL_RESULTS = ("results", f"""
SELECT m.id, m.ord, m.subject, m.sender, v.category, v.relevance_score, v.topics, v.reason,
       {O.keep_flag('v.category', 'v.relevance_score', THR)} AS kept
FROM messages m JOIN verdicts v ON v.id = m.id""")


def results(fx: Fixtures) -> DataFrame:
    m = fx.messages().select("id", "ord", "subject", "sender")
    return TR.split_kept_discarded(m.join(fx.verdicts().drop("ord"), "id"), CFG)


@register("inbox_actions", O.compose([SQL_RESULTS],
    f"""SELECT id, action, CASE WHEN action = 'label' THEN {O.q(K.KEEP_LABEL)} END AS label,
               (row_number() OVER (PARTITION BY action ORDER BY ord) - 1) // {K.ACTION_BATCH_SIZE} AS batch_no
        FROM (SELECT id, ord, CASE WHEN kept THEN 'label' ELSE 'mark_read' END AS action FROM results)"""))
def q_inbox_actions(fx: Fixtures) -> DataFrame:
    """Label kept messages, mark the rest read, in batches of 1000 ids."""
    return sinks.inbox_actions(results(fx))


@register("fetched_listing", O.compose(STATE_CTES,
    f"""SELECT *, concat(CAST(n AS VARCHAR), '. ', subject, chr(10), '   From: ', sender, chr(10), '   Date: ', date,
                         chr(10), '   Snippet: ', snippet, chr(10)) AS line
        FROM (SELECT row_number() OVER (ORDER BY ord) AS n, subject, sender,
                     strftime(to_timestamp(received_epoch), '%a, %d %b %Y %H:%M:%S +0000') AS date,
                     substr(snippet, 1, {K.LISTING_SNIPPET_CHARS}) AS snippet
              FROM fetched)
        UNION ALL
        SELECT 0, NULL, NULL, NULL, NULL, concat('Fetched ', count(*), ' emails (query: category:updates is:unread is:important)', chr(10))
        FROM fetched"""))
def q_fetched_listing(fx: Fixtures) -> DataFrame:
    """Numbered listing of the fetched messages."""
    return sinks.fetched_listing(fetched(fx))


@register("triage_report", O.compose([SQL_RESULTS],
    f"""SELECT *, concat('  [', coalesce(category, 'None'), '] score=', score, '  ', subject, chr(10), '    From: ', sender,
                         CASE WHEN section = 'KEPT' THEN concat(chr(10), '    Topics: ', topics) ELSE '' END,
                         chr(10), '    Reason: ', coalesce(reason, 'None'), chr(10)) AS line
        FROM (SELECT section, row_number() OVER (PARTITION BY section ORDER BY relevance_score DESC, ord) AS rank,
               id, category, printf('%.2f', relevance_score) AS score, subject, sender,
               CASE WHEN section = 'KEPT' THEN CASE WHEN coalesce(len(topics), 0) > 0
                    THEN array_to_string(topics, ', ') ELSE {O.q(K.REPORT_NO_TOPICS)} END END AS topics, reason
        FROM (SELECT *, CASE WHEN kept THEN 'KEPT' ELSE 'DISCARDED' END AS section FROM results))
        UNION ALL
        SELECT 'KEPT', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               concat('Triage results: ', count(*) FILTER (WHERE kept), ' kept / ', count(*), ' total', chr(10), chr(10),
                      repeat('=', 60), chr(10), 'KEPT', chr(10), repeat('=', 60)) FROM results
        UNION ALL
        SELECT 'DISCARDED', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
               concat(repeat('=', 60), chr(10), 'DISCARDED', chr(10), repeat('=', 60))"""))
def q_triage_report(fx: Fixtures) -> DataFrame:
    """KEPT / DISCARDED report sorted by score."""
    return sinks.triage_report(results(fx))


# -- the whole run: digest_sink ------------------------------------------------

SQL_RUN_KEPT = ("kept_m", f"""
SELECT f.id, f.ord, f.sender, f.subject, f.snippet, f.body_html, f.body_text, v.category, v.topics
FROM fresh f JOIN verdicts v ON v.id = f.id
WHERE {O.keep_flag('v.category', 'v.relevance_score', THR)}""")
N = CFG.max_synthesis_items
SQL_RUN_ITEMS = ("items_f", f"""
SELECT id AS email_id, ord, {O.source_name('sender')} AS source_name, topics, category,
       CASE WHEN len(t) > {CFG.token_budget} THEN {O.chunked_fallback_summary('t', CFG.token_budget, CFG.window_stride)}
            ELSE full_content END AS summary_text,
       link_url, subject AS email_subject,
       CASE category WHEN 'high_relevance' THEN 0 WHEN 'general_info' THEN 1 ELSE 2 END AS priority
FROM tok""")
RUN_CTES = [*STATE_CTES, SQL_FRESH, SQL_RUN_KEPT, SQL_BASE, SQL_HIGH, *O.best_link_ctes("hl", "high_m"), SQL_PG,
            SQL_ART, SQL_ITEMS, SQL_TOK, SQL_RUN_ITEMS,
            ("capped_i", f"SELECT * FROM items_f ORDER BY priority, ord LIMIT {N}"),
            ("fb", f"""SELECT count(*) AS n_items,
                CASE WHEN count(*) = 0 THEN {O.q(K.EMPTY_DIGEST)} ELSE concat({O.q(K.FALLBACK_HEADER + chr(10))},
                     string_agg({sql_fallback_line()}, chr(10) ORDER BY priority, ord)) END AS md FROM capped_i"""),
            ("src", f"""SELECT CASE WHEN count(*) = 0 THEN '' ELSE concat({O.q(K.SOURCES_HEADER + chr(10))},
                     string_agg({sql_bullet()}, chr(10) ORDER BY priority, ord)) END AS sources_md
                FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY priority, ord) AS r
                      FROM capped_i WHERE coalesce(email_id, '') <> '') WHERE r = 1)""")]


@register("digest_sink", O.compose(RUN_CTES,
    f"""SELECT concat({O.q(K.SUBJECT_PREFIX)},
                      CASE WHEN hour(to_timestamp(a.as_of)) < {K.MORNING_BEFORE_HOUR} THEN 'Morning' ELSE 'Evening' END,
                      ', ', strftime(to_timestamp(a.as_of), '%B %d, %Y')) AS subject,
               CASE WHEN src.sources_md <> '' THEN concat(fb.md, chr(10) || chr(10), src.sources_md) ELSE fb.md END
                 AS digest_md,
               fb.n_items
        FROM fb, src, run_at a"""))
def q_digest_sink(fx: Fixtures) -> DataFrame:
    """S13 (dry run): the digest one complete run produces — cutoff, scan, dedupe,
    keep, extract, cap, fallback digest with sources."""
    out = run_digest(fx.messages(), fx.verdicts(), fx.pages(), fx.processed_messages(), fx.runs(), as_of(fx), CFG)
    return sinks.digest_sink(out.digest, None, dry_run=True)
