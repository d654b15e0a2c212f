"""Registered triage queries: keep rule, per-sender cap, priority cap, splits, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators import digest as D
from sifter.operators import triage as TR
from sifter.operators.state_ops import anti_join_processed
from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.sources.fixtures import Fixtures

THR = CFG.triage_score_threshold
NPS = CFG.max_per_sender

# -- shared SQL fragments -----------------------------------------------------

SQL_TRIAGED = ("triaged", f"""
SELECT m.id, m.ord, m.sender, v.category, v.relevance_score, v.topics, v.reason,
       {O.normalize_sender('m.sender')} AS sender_key,
       {O.keep_flag('v.category', 'v.relevance_score', THR)} AS kept
FROM messages m JOIN verdicts v ON v.id = m.id""")
SQL_KEPT = ("kept", "SELECT * FROM triaged WHERE kept")
SQL_CAPPED = ("capped", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender_key ORDER BY relevance_score DESC, ord) AS sender_rank
               FROM kept) WHERE sender_rank <= {NPS}""")
SQL_PRIORITY = "CASE category WHEN 'high_relevance' THEN 0 WHEN 'general_info' THEN 1 ELSE 2 END"


def triaged(fx: Fixtures) -> DataFrame:
    """Messages joined to their verdicts, with the normalised sender key."""
    m = fx.messages().select("id", "ord", "sender")
    v = fx.verdicts().select("id", "category", "relevance_score", "topics", "reason")
    return TR.with_sender_key(m.join(v, "id"))


def kept(fx: Fixtures) -> DataFrame:
    return TR.keep_filter(triaged(fx), CFG)


# -- flagship: top 25 kept, unprocessed messages, <= 3 per sender -------------

@register("priority_cap", O.compose([
    ("unprocessed", """SELECT m.id, m.ord, m.sender FROM messages m
                       WHERE NOT EXISTS (SELECT 1 FROM processed_messages p WHERE p.message_id = m.id)"""),
    ("kept", f"""SELECT u.id, u.ord, v.category, v.relevance_score, {O.normalize_sender('u.sender')} AS sender_key
                 FROM unprocessed u JOIN verdicts v ON v.id = u.id
                 WHERE {O.keep_flag('v.category', 'v.relevance_score', THR)}"""),
    SQL_CAPPED],
    f"""SELECT id, ord, sender_key, category, relevance_score, {SQL_PRIORITY} AS priority
        FROM capped ORDER BY priority, ord LIMIT {CFG.max_synthesis_items}"""))
def q_priority_cap(fx: Fixtures) -> DataFrame:
    """J1 -> P2 -> F1 -> W1 -> T1: the digest's candidate list."""
    m = anti_join_processed(fx.messages().select("id", "ord", "sender"), fx.processed_messages())
    v = fx.verdicts().select("id", "category", "relevance_score")
    k = TR.keep_filter(TR.with_sender_key(m.join(v, "id")), CFG)
    capped = TR.top_n_per_sender(k, NPS)
    top = D.priority_cap(capped, CFG.max_synthesis_items)
    return top.select("id", "ord", "sender_key", "category", "relevance_score", "priority")


@register("keep_filter", O.compose([SQL_TRIAGED],
    "SELECT id, ord, category, relevance_score FROM triaged WHERE kept"))
def q_keep_filter(fx: Fixtures) -> DataFrame:
    """Category is not 'discard' and score >= threshold."""
    return kept(fx).select("id", "ord", "category", "relevance_score")


@register("top_n_per_sender", O.compose([SQL_TRIAGED, SQL_KEPT, SQL_CAPPED],
    "SELECT id, ord, sender_key, relevance_score, sender_rank FROM capped"))
def q_top_n_per_sender(fx: Fixtures) -> DataFrame:
    """At most 3 kept messages per normalised sender."""
    return TR.top_n_per_sender(kept(fx), NPS).select("id", "ord", "sender_key", "relevance_score",
                                                    F.col("sender_rank").cast("long").alias("sender_rank"))


@register("distinct_senders", O.compose([SQL_TRIAGED, SQL_KEPT],
    "SELECT sender_key, count(*) AS n_items FROM kept GROUP BY sender_key"))
def q_distinct_senders(fx: Fixtures) -> DataFrame:
    """Kept messages per normalised sender."""
    return TR.distinct_senders(kept(fx))


@register("triage_summary", O.compose([SQL_TRIAGED, SQL_KEPT, SQL_CAPPED],
    """SELECT (SELECT count(*) FROM capped) AS kept, (SELECT count(*) FROM triaged) AS total,
              (SELECT count(*) FROM capped WHERE category = 'high_relevance') AS high_relevance,
              (SELECT count(*) FROM capped WHERE category = 'general_info') AS general_info,
              (SELECT count(*) FROM triaged) - (SELECT count(*) FROM capped) AS discarded"""))
def q_triage_summary(fx: Fixtures) -> DataFrame:
    """A1: counts after the per-sender cap (the triage API's log line)."""
    t = triaged(fx)
    capped = TR.top_n_per_sender(TR.keep_filter(t, CFG), NPS)
    return TR.triage_summary(t, capped)


@register("split_kept_discarded", O.compose([SQL_TRIAGED], "SELECT id, ord, kept FROM triaged"))
def q_split_kept_discarded(fx: Fixtures) -> DataFrame:
    """Every triage result with its kept flag."""
    v = fx.verdicts()
    return TR.split_kept_discarded(v, CFG).select("id", "ord", "kept")


@register("id_complement", O.compose([SQL_TRIAGED],
    "SELECT id FROM triaged EXCEPT SELECT id FROM triaged WHERE kept"))
def q_id_complement(fx: Fixtures) -> DataFrame:
    """Discarded ids = all - kept."""
    v = fx.verdicts()
    return TR.id_complement(v, TR.keep_filter(v, CFG))


@register("score_sort", O.compose([SQL_TRIAGED],
    "SELECT id, ord, relevance_score FROM triaged ORDER BY relevance_score DESC, ord"))
def q_score_sort(fx: Fixtures) -> DataFrame:
    """Every triage result, score descending, ties in input order."""
    return D.score_sort(fx.verdicts().select("id", "ord", "relevance_score"))


# -- batching, prompts, replayed model output, verdict parsing ---------------

from sifter.functions import constants as K  # noqa: E402
from sifter.functions import text as T  # noqa: E402
from sifter.functions.templates import sql_fill  # noqa: E402
from sifter.sources.fixtures import REPLAY_MODES, replay_responses  # noqa: E402

SQL_BATCHED = ("b", """
SELECT id, ord, subject, sender, snippet, body_text,
       (row_number() OVER (ORDER BY ord) - 1) // 20 AS batch_id,
       CAST((row_number() OVER (ORDER BY ord) - 1) % 20 + 1 AS INTEGER) AS idx
FROM messages""")


def _sql_obj(cat: str, score: str, rest: bool = True) -> str:
    if not rest:
        return f"json_object('category', {cat})::VARCHAR"
    return f"json_object('category', {cat}, 'relevance_score', {score}, 'topics', topics, 'reason', reason)::VARCHAR"


SQL_REPLAY = [
    ("bv", f"""SELECT b.batch_id, b.idx, b.batch_id % {REPLAY_MODES} AS mode, v.category, v.relevance_score, v.topics,
                      v.reason, count(*) OVER (PARTITION BY b.batch_id) AS n_emails
               FROM b JOIN verdicts v ON v.id = b.id"""),
    ("el", f"""SELECT batch_id, idx, mode, n_emails, CASE
         WHEN mode = 1 AND idx = 1 THEN {_sql_obj('category', 'NULL')}
         WHEN mode = 2 AND idx = 1 THEN {_sql_obj('category', "'abc'")}
         WHEN mode = 3 AND idx = 1 THEN {_sql_obj('category', 'true')}
         WHEN mode = 3 AND idx = 2 THEN {_sql_obj('category', 'CAST(relevance_score AS VARCHAR)')}
         WHEN mode = 13 AND idx = 1 THEN '"oops"'
         WHEN mode = 14 AND idx = 1 THEN {_sql_obj('category', '', rest=False)}
         WHEN mode = 14 AND idx = 2 THEN {_sql_obj('NULL', 'relevance_score')}
         WHEN mode = 14 AND idx = 3 THEN {_sql_obj("'newsletter'", 'relevance_score')}
         ELSE {_sql_obj('category', 'relevance_score')} END AS el
       FROM bv"""),
    ("arr", """SELECT batch_id, any_value(mode) AS mode, any_value(n_emails) AS n_emails,
                 concat('[', coalesce(string_agg(el, ',' ORDER BY idx) FILTER (WHERE NOT (mode = 8 AND idx > n_emails - 3)), ''),
                        CASE WHEN any_value(mode) = 9 THEN ',{"category":"discard"}' ELSE '' END, ']') AS a
               FROM el GROUP BY batch_id"""),
    ("resp", """SELECT batch_id, n_emails, CASE mode
                   WHEN 4 THEN concat('```json', chr(10), a, chr(10), '```')
                   WHEN 5 THEN substr(a, 1, length(a) - 7)
                   WHEN 6 THEN ''
                   WHEN 7 THEN NULL
                   WHEN 10 THEN '[]'
                   WHEN 11 THEN '{}'
                   WHEN 12 THEN concat('{"verdicts":', a, '}')
                   WHEN 15 THEN concat(a, ' trailing words')
                   WHEN 16 THEN concat(a, ' see [1]')
                   WHEN 17 THEN concat(a, '[]')
                   WHEN 18 THEN '{} and {}'
                   ELSE a END AS response
               FROM arr"""),
]


def sql_fence_strip(x: str) -> str:
    s = O.py_strip(x)
    inner = O.py_strip(f"array_to_string(list_slice(string_split({s}, chr(10)), 2, len(string_split({s}, chr(10))) - 1), chr(10))")
    return f"(CASE WHEN starts_with({s}, '```') THEN {inner} ELSE {s} END)"


def sql_score(el: str) -> str:
    sv = f"json_extract({el}, '$.relevance_score')"
    return (f"(CASE json_type({sv}) WHEN 'BIGINT' THEN {sv}::DOUBLE WHEN 'UBIGINT' THEN {sv}::DOUBLE "
            f"WHEN 'DOUBLE' THEN {sv}::DOUBLE "
            f"WHEN 'BOOLEAN' THEN CASE WHEN {sv}::VARCHAR = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
            f"WHEN 'VARCHAR' THEN TRY_CAST(json_extract_string({el}, '$.relevance_score') AS DOUBLE) END)")


SQL_PARSE = [
    ("rt", f"SELECT batch_id, n_emails, response, {sql_fence_strip('response')} AS t FROM resp"),
    ("rs", "SELECT *, response IS NULL AS call_failed, response IS NOT NULL AND json_valid(t) AS valid FROM rt"),
    ("rk", "SELECT *, CASE WHEN valid THEN json_type(t) END AS jt FROM rs"),
    ("rn", """SELECT *, CASE WHEN jt = 'ARRAY' THEN json_array_length(t)
                             WHEN jt = 'OBJECT' AND len(json_keys(t)) = 0 THEN 0
                             WHEN jt = 'VARCHAR' AND json_extract_string(t, '$') = '' THEN 0 END AS n_arr FROM rk"""),
    ("rows_", """SELECT b.id, b.ord, b.batch_id, b.idx, rn.call_failed, rn.valid, rn.n_arr,
                        CASE WHEN rn.n_arr IS NOT NULL AND b.idx <= rn.n_arr
                             THEN json_extract(rn.t, concat('$[', b.idx - 1, ']')) END AS el
                 FROM b LEFT JOIN rn ON rn.batch_id = b.batch_id"""),
    ("rf", f"""SELECT *, coalesce(el IS NOT NULL AND (json_type(el) <> 'OBJECT'
                         OR (json_extract(el, '$.relevance_score') IS NOT NULL AND {sql_score('el')} IS NULL)), false) AS bad
               FROM rows_"""),
    ("st", """SELECT *, CASE WHEN call_failed IS NULL OR call_failed THEN 'failed' WHEN NOT valid THEN 'bad_json'
                             WHEN n_arr IS NULL THEN 'failed'
                             WHEN bool_or(bad) OVER (PARTITION BY batch_id) THEN 'failed' ELSE 'ok' END AS status
              FROM rf"""),
    ("pv", f"""SELECT id, ord, batch_id, idx, status,
        CASE WHEN status = 'failed' THEN {O.q(K.FAILED_CALL_VERDICT[0])} WHEN status = 'bad_json' THEN {O.q(K.BAD_JSON_VERDICT[0])}
             WHEN el IS NULL THEN {O.q(K.MISSING_VERDICT[0])}
             WHEN json_extract(el, '$.category') IS NULL THEN {O.q(K.ELEMENT_DEFAULT_CATEGORY)}
             WHEN json_type(json_extract(el, '$.category')) = 'NULL' THEN NULL
             ELSE json_extract_string(el, '$.category') END AS category,
        CASE WHEN status = 'failed' THEN {K.FAILED_CALL_VERDICT[1]}::DOUBLE WHEN status = 'bad_json' THEN 0.0::DOUBLE
             WHEN el IS NULL THEN 0.0::DOUBLE
             ELSE coalesce({sql_score('el')}, {K.ELEMENT_DEFAULT_SCORE}::DOUBLE) END AS relevance_score,
        CASE WHEN status <> 'ok' OR el IS NULL OR json_extract(el, '$.topics') IS NULL THEN []::VARCHAR[]
             WHEN json_type(json_extract(el, '$.topics')) = 'NULL' THEN NULL
             ELSE json_extract_string(el, '$.topics[*]') END AS topics,
        CASE WHEN status = 'failed' THEN {O.q(K.FAILED_CALL_VERDICT[2])} WHEN status = 'bad_json' THEN {O.q(K.BAD_JSON_VERDICT[2])}
             WHEN el IS NULL THEN {O.q(K.MISSING_VERDICT[2])}
             WHEN json_extract(el, '$.reason') IS NULL THEN ''
             WHEN json_type(json_extract(el, '$.reason')) = 'NULL' THEN NULL
             ELSE json_extract_string(el, '$.reason') END AS reason
        FROM st"""),
]


def batched(fx: Fixtures) -> DataFrame:
    return TR.assign_batches(TR.triage_input(fx.messages()))


def responses(fx: Fixtures, b: DataFrame | None = None) -> DataFrame:
    return replay_responses(batched(fx) if b is None else b, fx.verdicts())


def parsed_verdicts(fx: Fixtures) -> DataFrame:
    b = batched(fx)
    return TR.positional_verdicts(b.select("id", "ord", "batch_id", "idx"), responses(fx, b))


@register("assign_batches", O.compose([SQL_BATCHED], "SELECT id, batch_id, idx FROM b"))
def q_assign_batches(fx: Fixtures) -> DataFrame:
    """Batches of 20 by input order (distributed global positions)."""
    return batched(fx).select("id", "batch_id", "idx")


SQL_BLOCK = sql_fill(K.TRIAGE_EMAIL_TEMPLATE, index="CAST(idx AS VARCHAR)", subject="subject", sender="sender",
                     preview=O.preview_text("snippet", "body_text"))


@register("prompt_block", O.compose([SQL_BATCHED], f"SELECT id, {SQL_BLOCK} AS block FROM b"))
def q_prompt_block(fx: Fixtures) -> DataFrame:
    """every message's block of its triage prompt."""
    return batched(fx).select("id", TR.prompt_block("idx", "subject", "sender", "preview").alias("block"))


@register("batch_pack", O.compose([SQL_BATCHED, ("blk", f"SELECT batch_id, idx, {SQL_BLOCK} AS block FROM b")],
    f"""SELECT batch_id, count(*) AS n_emails,
               {sql_fill(K.TRIAGE_USER, count="CAST(count(*) AS VARCHAR)",
                         emails_block="string_agg(block, chr(10) ORDER BY idx)")} AS prompt
        FROM blk GROUP BY batch_id"""))
def q_batch_pack(fx: Fixtures) -> DataFrame:
    """A5: one triage prompt per batch of 20."""
    return TR.batch_pack(batched(fx), CFG).select("batch_id", "n_emails", "prompt")


@register("strip_code_fence", O.compose([SQL_BATCHED, *SQL_REPLAY],
    f"SELECT batch_id, {sql_fence_strip('response')} AS text FROM resp"))
def q_strip_code_fence(fx: Fixtures) -> DataFrame:
    """model output with a surrounding code fence removed."""
    return responses(fx).select("batch_id", T.strip_code_fence("response").alias("text"))


@register("parse_verdict_json", O.compose([SQL_BATCHED, *SQL_REPLAY, *SQL_PARSE],
    "SELECT DISTINCT batch_id, status FROM st"))
def q_parse_verdict_json(fx: Fixtures) -> DataFrame:
    """how each batch's output reads: ok / bad_json / failed."""
    return TR.read_responses(responses(fx)).select("batch_id", "status")


@register("positional_verdict_join", O.compose([SQL_BATCHED, *SQL_REPLAY, *SQL_PARSE],
    """SELECT id, batch_id, idx, category, relevance_score, array_to_string(topics, '|') AS topics, reason
       FROM pv"""))
def q_positional_verdict_join(fx: Fixtures) -> DataFrame:
    """Verdict i of a batch -> its i-th message, with the failure defaults."""
    return parsed_verdicts(fx).select("id", "batch_id", "idx", "category", "relevance_score",
                                      F.array_join("topics", "|").alias("topics"), "reason")


def _sql_rubric() -> str:
    text = f"concat_ws(chr(10), subject, sender, {O.preview_text('snippet', 'body_text')})"
    rule = " ".join(f"WHEN regexp_matches({text}, {O.q('(?i)(' + p + ')')}) THEN {O.q(n)}"
                    for n, p in TR.RUBRIC_DISCARD_RULES)
    topical = f"regexp_matches({text}, {O.q(TR.topic_pattern(CFG))})"
    return f"""SELECT id, ord,
        CASE WHEN rule IS NOT NULL THEN 'discard' WHEN topical THEN 'high_relevance' ELSE 'general_info' END AS category,
        CASE WHEN rule IS NOT NULL THEN 0.0::DOUBLE WHEN topical THEN {TR.RUBRIC_HIGH_SCORE}::DOUBLE
             ELSE {TR.RUBRIC_GENERAL_SCORE}::DOUBLE END AS relevance_score,
        coalesce(rule, CASE WHEN topical THEN 'topic' ELSE 'editorial' END) AS rule
      FROM (SELECT id, ord, CASE {rule} END AS rule, {topical} AS topical FROM messages)"""


@register("rubric_label", O.compose([], _sql_rubric()))
def q_rubric_label(fx: Fixtures) -> DataFrame:
    """Rubric rules (first match wins) as the offline verdict source."""
    return TR.rubric_label(fx.messages(), CFG)
