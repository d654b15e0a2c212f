"""Triage: batches, prompts, model scoring, verdict parsing, keep rule, per-sender cap.

Operators W2, F15, A5, U3, F12, F13, J3, J5, P2, W1, A9, A1, J2, U2.
Only ``score_batches`` runs Python (a user-supplied model callable); verdict
parsing, the failure rules and all filtering stay native.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.functions import constants as K
from sifter.functions.templates import fill
from sifter.functions.text import normalize_sender, preview_text, strip_code_fence
from sifter.operators.keyword_rules import RULES_SCHEMA, first_rules
from sifter.operators.model_calls import CallPolicy, ClientPerPartition, ModelFn, answered
from sifter.operators.ordering import ordered_position

# ---------------------------------------------------------------------------
# batching and prompts
# ---------------------------------------------------------------------------


def assign_batches(messages: DataFrame, batch_size: int = K.TRIAGE_BATCH_SIZE) -> DataFrame:
    """Batch number (0-based) and 1-based index within the batch, by input order ``ord``."""
    pos = ordered_position(messages, ["ord"])
    p0 = F.col("pos") - 1
    return (pos.withColumn("batch_id", F.floor(p0 / batch_size).cast("long"))
            .withColumn("idx", (p0 % batch_size + 1).cast("int")).drop("pos"))


def triage_input(messages: DataFrame) -> DataFrame:
    """The columns triage reads: the 600-character preview replaces the body, so
    batching shuffles and materialises narrow rows only.  A NULL field reads as '' (a NULL
    block would drop out of the prompt and shift every later verdict of its batch)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return messages.select("id", "ord", text(F.col("subject")).alias("subject"), text(F.col("sender")).alias("sender"),
                           text(preview_text("snippet", "body_text")).alias("preview"))


def prompt_block(idx, subject, sender, preview) -> Column:
    """one message's block of the triage prompt."""
    return fill(K.TRIAGE_EMAIL_TEMPLATE, index=F.col(idx).cast("string"), subject=F.col(subject),
                sender=F.col(sender), preview=F.col(preview))


def system_prompt(cfg: DigestConfig) -> str:
    return K.TRIAGE_SYSTEM.replace("{topics}", ", ".join(cfg.relevance_topics))


def ordered_join(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: values joined by ``sep`` in ``order`` (bounded groups only)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))),
                                    lambda x: x["v"]), sep)


def batch_pack(batched: DataFrame, cfg: DigestConfig) -> DataFrame:
    """A5: one row per batch: (batch_id, n_emails, system, prompt).  Groups hold <= 20 rows."""
    blocks = batched.select("batch_id", "idx",
                            prompt_block("idx", "subject", "sender", "preview").alias("block"))
    agg = blocks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_emails"),
                                         ordered_join(F.col("block"), F.col("idx"), "\n").alias("emails_block"))
    return agg.select("batch_id", "n_emails", F.lit(system_prompt(cfg)).alias("system"),
                      fill(K.TRIAGE_USER, count=F.col("n_emails").cast("string"),
                           emails_block=F.col("emails_block")).alias("prompt"))


# ---------------------------------------------------------------------------
# Model scoring through a user callable
# ---------------------------------------------------------------------------

def score_batches(packed: DataFrame, model: ModelFn | ClientPerPartition, parallelism: int | None = None,
                  policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Call ``model(system, prompt) -> text`` once per batch; an exception gives NULL.

    Runs in ``mapInPandas`` (Arrow batches), the prompts spread over
    ``parallelism`` tasks (default: the shuffle partitions), with the calls in
    flight and the retries of ``policy``.  The result must be materialised once
    by the caller (``stored``) so a retry of a task's consumers or a second
    action does not call the model again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in answered(batches, model, policy, lambda p: list(zip(p["system"], p["prompt"])), "response"):
            yield pdf[["batch_id", "n_emails", "response"]]

    tasks = parallelism or int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.select("batch_id", "n_emails", "system", "prompt").repartition(tasks, "batch_id").mapInPandas(
        run, "batch_id long, n_emails long, response string")


# ---------------------------------------------------------------------------
# Reading the model output with the reference's failure rules
# ---------------------------------------------------------------------------

#: Name of the field that must still stand behind the value for it to be complete.
_AFTER = "\u0001after"


def _strict_json(text: Column) -> Column:
    """The text as one complete JSON value, else NULL.

    The parser accepts words after a value, so the value is parsed as a field
    with another one behind it: anything between the two makes the object invalid."""
    holder = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"\\u0001after":0}')))
    whole = F.try_variant_get(holder, f"$['{_AFTER}']", "int") == 0
    return F.when(whole, F.try_variant_get(holder, "$.value", "variant"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))


def _field(el: Column, name: str) -> Column:
    return F.try_variant_get(el, f"$.{name}", "variant")


def _score_value(el: Column) -> Column:
    return F.try_variant_get(_field(el, "relevance_score"), "$", "double")


def _score_bad(el: Column) -> Column:
    """``float(value)`` raises: present but NULL / non-numeric string / container."""
    sv = _field(el, "relevance_score")
    return sv.isNotNull() & _score_value(el).isNull()


def read_responses(responses: DataFrame) -> DataFrame:
    """Per batch: response status and the elements that matter (at most ``n_emails``).

    Output: (batch_id, status, elements array<variant>) with status one of
    ``failed`` (call failed, or reading raised), ``bad_json``, ``ok``.
    Each step is its own projection so every parse runs once per response.
    """
    empty = F.array().cast("array<variant>")
    r = responses.select("batch_id", "n_emails", "response", strip_code_fence(F.col("response")).alias("_t"))
    r = r.select("*", _strict_json(F.col("_t")).alias("_v"))
    r = r.select("*", _kind(F.col("_v")).alias("_kind"))
    kind = F.col("_kind")
    r = r.select("*", F.when(kind.startswith("ARRAY"), F.try_variant_get(F.col("_v"), "$", "array<variant>"))
                 .when(kind == "OBJECT<>", empty)
                 .when((kind == "STRING") & (F.try_variant_get(F.col("_v"), "$", "string") == ""), empty)
                 .alias("_arr"))
    r = r.select("*", F.slice(F.col("_arr"), 1, F.col("n_emails").cast("int")).alias("_considered"))
    r = r.select("*", F.exists("_considered", lambda el: ~_is_object(el) | _score_bad(el)).alias("_bad"))
    status = (F.when(F.col("response").isNull(), F.lit("failed"))
              .when(F.col("_v").isNull(), F.lit("bad_json"))
              .when(F.col("_arr").isNull(), F.lit("failed"))          # non-empty object, scalar, null
              .when(F.col("_bad"), F.lit("failed"))
              .otherwise(F.lit("ok")))
    r = r.select("batch_id", "_considered", status.alias("status"))
    return r.select("batch_id", "status", F.when(F.col("status") == "ok", F.col("_considered")).alias("elements"))


def positional_verdicts(batched: DataFrame, responses: DataFrame) -> DataFrame:
    """J3 + F13: element i of a batch's output belongs to the batch's i-th message.

    ``batched`` carries (id, batch_id, idx, ...); the result adds category,
    relevance_score, topics, reason.  Missing elements and failed batches get
    the reference's defaults.  One equi-join on batch_id; the element is
    picked by position within the row (``get``), so extra elements are ignored.
    """
    read = read_responses(responses)
    keep = list(batched.columns)
    j = batched.join(read, "batch_id", "left")
    j = j.select(*keep, "status", F.get(F.col("elements"), F.col("idx") - 1).alias("_el"))
    el = F.col("_el")
    j = j.select(*keep, "status", "_el", _field(el, "category").alias("_cv"), _field(el, "topics").alias("_tv"),
                 _field(el, "reason").alias("_rv"), _score_value(el).alias("_sd"))
    cv, tv, rv = F.col("_cv"), F.col("_tv"), F.col("_rv")

    def pick(failed, bad, missing, ok) -> Column:
        return (F.when(F.col("status").isNull() | (F.col("status") == "failed"), failed)
                .when(F.col("status") == "bad_json", bad)
                .when(el.isNull(), missing)
                .otherwise(ok))

    empty = F.array().cast("array<string>")
    category = pick(F.lit(K.FAILED_CALL_VERDICT[0]), F.lit(K.BAD_JSON_VERDICT[0]), F.lit(K.MISSING_VERDICT[0]),
                    F.when(cv.isNull(), F.lit(K.ELEMENT_DEFAULT_CATEGORY))
                    .when(F.is_variant_null(cv), F.lit(None).cast("string"))
                    .otherwise(F.try_variant_get(cv, "$", "string")))
    score = pick(F.lit(K.FAILED_CALL_VERDICT[1]), F.lit(K.BAD_JSON_VERDICT[1]), F.lit(K.MISSING_VERDICT[1]),
                 F.coalesce(F.col("_sd"), F.lit(K.ELEMENT_DEFAULT_SCORE)))
    topics = pick(empty, empty, empty,
                  F.when(tv.isNull(), empty).when(F.is_variant_null(tv), F.lit(None).cast("array<string>"))
                  .otherwise(F.try_variant_get(tv, "$", "array<string>")))
    reason = pick(F.lit(K.FAILED_CALL_VERDICT[2]), F.lit(K.BAD_JSON_VERDICT[2]), F.lit(K.MISSING_VERDICT[2]),
                  F.when(rv.isNull(), F.lit("")).when(F.is_variant_null(rv), F.lit(None).cast("string"))
                  .otherwise(F.try_variant_get(rv, "$", "string")))
    return j.select(*keep, category.alias("category"), score.cast("double").alias("relevance_score"),
                    topics.alias("topics"), reason.alias("reason"))


# ---------------------------------------------------------------------------
# P2, W1, A9, A1, J2, U2
# ---------------------------------------------------------------------------


def keep_flag(category: Column, score: Column, threshold: float) -> Column:
    """Kept iff category is not 'discard' (NULL is kept) and score >= threshold (NaN is not)."""
    return (~F.coalesce(category == K.CATEGORY_DISCARD, F.lit(False))
            & F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False)))


def keep_filter(verdicts: DataFrame, cfg: DigestConfig) -> DataFrame:
    return verdicts.where(keep_flag(F.col("category"), F.col("relevance_score"), cfg.triage_score_threshold))


def with_sender_key(df: DataFrame) -> DataFrame:
    return df.withColumn("sender_key", normalize_sender("sender"))


def top_n_per_sender(kept: DataFrame, n: int) -> DataFrame:
    """At most ``n`` per normalised sender, highest score first, ties by input order.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so a hot sender ships at most n rows per map task.
    """
    w = Window.partitionBy("sender_key").orderBy(F.col("relevance_score").desc(), F.col("ord"))
    return (kept.withColumn("sender_rank", F.row_number().over(w))
            .where(F.col("sender_rank") <= n))


def distinct_senders(kept: DataFrame) -> DataFrame:
    """Number of kept items per normalised sender."""
    return kept.groupBy("sender_key").agg(F.count(F.lit(1)).alias("n_items"))


def triage_summary(all_results: DataFrame, kept: DataFrame) -> DataFrame:
    """A1: kept / total / high / general / discarded (= total - kept), one row."""
    k = kept.agg(F.count(F.lit(1)).alias("kept"),
                 F.count_if(F.col("category") == K.CATEGORY_HIGH).alias("high_relevance"),
                 F.count_if(F.col("category") == K.CATEGORY_GENERAL).alias("general_info"))
    total = all_results.select(F.count(F.lit(1))).scalar()      # scalar subquery
    return k.select("kept", total.alias("total"), "high_relevance", "general_info",
                    (total - F.col("kept")).alias("discarded"))


def split_kept_discarded(verdicts: DataFrame, cfg: DigestConfig) -> DataFrame:
    """Every triage result with its kept flag (membership in the kept set, no join)."""
    return verdicts.withColumn("kept", keep_flag(F.col("category"), F.col("relevance_score"),
                                                 cfg.triage_score_threshold))


def id_complement(all_results: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of all results that are not kept (left anti on id)."""
    return all_results.select("id").join(kept.select("id"), "id", "left_anti")


# ---------------------------------------------------------------------------
# Rubric rules as a keyword table, first match wins
# ---------------------------------------------------------------------------

# Discard kinds from the written rubric, as (label, case-insensitive pattern): what the
# offline model stand-in reads, and what the keyword table below must say.
RUBRIC_DISCARD_RULES = [
    ("receipt", r"order confirm|receipt|invoice|billing statement"),
    ("shipping", r"shipping|delivery notification|tracking (number|update)|has shipped"),
    ("social_alert", r"reddit|linkedin notification|social media alert|new follower"),
    ("promotion", r"flash sale|discount code|coupon|promo code|[0-9]+% off"),
    ("automated_notification", r"jira|dependabot|ci/cd|build (failed|passed)|github bot"),
    ("property_notice", r"appointment|lease|rent due|property management"),
    ("utility_alert", r"utility alert|power outage|outage notice"),
    ("account_security", r"password reset|reset your password|2fa|verification code|login alert|verify your email"),
    ("policy_update", r"terms of service|app update|privacy policy update"),
    ("food_delivery", r"food delivery|your order from|doordash|ubereats"),
    ("job_alert", r"job alert|new jobs|job listing"),
    ("health_billing", r"health.{0,20}(bill|schedul)|patient portal"),
    ("status_page", r"incident|status page|feature down|outage report"),
    ("sports", r"final score|game recap|box score"),
    ("qa_digest", r"quora digest|q&a digest"),
    ("event_invite", r"rsvp|you are invited|event invitation"),
    ("citizen_science", r"citizen science|crowdsourcing"),
    ("saas_pricing", r"pricing update|new pricing|feature announcement"),
    ("transactional", r"do not reply|no-reply notification|automated message"),
]
RUBRIC_HIGH_SCORE = 0.7
RUBRIC_GENERAL_SCORE = 0.5


def topic_pattern(cfg: DigestConfig) -> str:
    import re
    return "(?i)(" + "|".join(re.escape(t) for t in cfg.relevance_topics) + ")"


#: The rubric's rules as keywords, in order of priority; (keyword, then, within) is a keyword that another one follows.
RUBRIC_KEYWORDS = [
    ("receipt", ["order confirm", "receipt", "invoice", "billing statement"]),
    ("shipping", ["shipping", "delivery notification", "tracking number", "tracking update", "has shipped"]),
    ("social_alert", ["reddit", "linkedin notification", "social media alert", "new follower"]),
    ("promotion", ["flash sale", "discount code", "coupon", "promo code", *(f"{d}% off" for d in range(10))]),
    ("automated_notification", ["jira", "dependabot", "ci/cd", "build failed", "build passed", "github bot"]),
    ("property_notice", ["appointment", "lease", "rent due", "property management"]),
    ("utility_alert", ["utility alert", "power outage", "outage notice"]),
    ("account_security", ["password reset", "reset your password", "2fa", "verification code", "login alert", "verify your email"]),
    ("policy_update", ["terms of service", "app update", "privacy policy update"]),
    ("food_delivery", ["food delivery", "your order from", "doordash", "ubereats"]),
    ("job_alert", ["job alert", "new jobs", "job listing"]),
    ("health_billing", [("health", "bill", 20), ("health", "schedul", 20), "patient portal"]),
    ("status_page", ["incident", "status page", "feature down", "outage report"]),
    ("sports", ["final score", "game recap", "box score"]),
    ("qa_digest", ["quora digest", "q&a digest"]),
    ("event_invite", ["rsvp", "you are invited", "event invitation"]),
    ("citizen_science", ["citizen science", "crowdsourcing"]),
    ("saas_pricing", ["pricing update", "new pricing", "feature announcement"]),
    ("transactional", ["do not reply", "no-reply notification", "automated message"]),
]
TOPIC_RULE, TOPIC_PRIORITY = "topic", 1_000_000


def rubric_rules(spark: SparkSession, cfg: DigestConfig, more: DataFrame | None = None) -> DataFrame:
    """The rubric as a rule table: the discard rules, ``more`` of them if given, and last the priority topics."""
    rows = [(name, k, *(word if isinstance(word, tuple) else (word, None, None)))
            for k, (name, words) in enumerate(RUBRIC_KEYWORDS) for word in words]
    rows += [(TOPIC_RULE, TOPIC_PRIORITY, t, None, None) for t in cfg.relevance_topics]
    table = spark.createDataFrame(rows, RULES_SCHEMA)
    return table if more is None else table.unionByName(more)


def rubric_label(messages: DataFrame, cfg: DigestConfig, rules: DataFrame | None = None) -> DataFrame:
    """Label each message by the first matching rule of a table (default: the rubric); no match ->
    high_relevance when a priority topic appears, else general_info.  All keywords are found in one pass."""
    text = F.concat_ws("\n", F.col("subject"), F.col("sender"), preview_text("snippet", "body_text"))
    df = first_rules(messages.select("id", "ord", text.alias("text")), rubric_rules(messages.sparkSession, cfg) if rules is None else rules,
                     ["id", "ord"])
    topical, discard = F.col("rule") == TOPIC_RULE, F.col("rule").isNotNull() & (F.col("rule") != TOPIC_RULE)
    return df.select(
        "id", "ord",
        F.when(discard, F.lit(K.CATEGORY_DISCARD)).when(topical, F.lit(K.CATEGORY_HIGH)).otherwise(F.lit(K.CATEGORY_GENERAL)).alias("category"),
        F.when(discard, F.lit(0.0)).when(topical, F.lit(RUBRIC_HIGH_SCORE)).otherwise(F.lit(RUBRIC_GENERAL_SCORE)).alias("relevance_score"),
        F.coalesce("rule", F.lit("editorial")).alias("rule"))
