"""Input tables and the message/verdict/state views derived from them by Spark.

The driver ships generic tables (``documents``, ``pages``, ``labels``,
``events``, ``conversations``).  These functions derive the views the
operators work on — the same definitions as FIXTURES.md §3 — with the
DataFrame API, so every query's work grows with the input tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH0 = 1704067200          # 2024-01-01T00:00:00Z
SECONDS_PER_DOC = 60

# FIXED VALUES — the run log of FIXTURES.md: the greatest id is not the latest time.
RUN_LOG = [(1, 1704067200, 120), (2, 1704085200, 0), (3, 1704081600, 57)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Deal a table's rows by a hash of ``key`` over ``tasks`` where it would be read by fewer (few files
    or row groups); a table of many files is read as it is, without a shuffle."""
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def _mod(c: Column, n) -> Column:
    return c % n


@dataclass
class Fixtures:
    """Lazily built views over one scale-factor folder."""

    spark: SparkSession
    sf_dir: str
    parallelism: int | None = None      # tasks of the per-message work; default: the shuffle partitions
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    # -- messages -------------------------------------------------------
    def messages(self) -> DataFrame:
        """messages(id, ord, subject, sender, received_epoch, label_ids, snippet, body_html, body_text)."""
        if "messages" in self._cache:
            return self._cache["messages"]
        docs = self.table("documents")
        pages = self.table("pages")
        n = pages.select(F.count(F.lit(1))).scalar()          # scalar subquery, not a cross join
        d = F.col("doc_id")
        nn = F.col("_n")
        keys = (docs.select(d, n.alias("_n"))
                .select(d, _mod(d, nn).alias("k0"), _mod(d * 7 + 1, nn).alias("k1"), _mod(d * 7 + 14, nn).alias("k2")))
        p0 = pages.select(F.col("page_id").alias("k0"), F.col("html"))
        p1 = pages.select(F.col("page_id").alias("k1"), F.col("url").alias("url1"))
        p2 = pages.select(F.col("page_id").alias("k2"), F.col("url").alias("url2"))
        lk = (keys.join(p0, "k0").join(p1, "k1").join(p2, "k2")
              .select(d, "html", "url1", "url2"))
        links = F.concat(
            F.lit('<p><a href="'),
            F.when(d % 3 == 1, F.lit("https://example.com/")).otherwise(F.col("url1")),
            F.lit('">'),
            F.when(d % 3 == 2, F.lit("open")).otherwise(F.lit("Read the full analysis")),
            F.lit('</a><a href="'), F.col("url2"), F.lit('">here</a>'),
            F.lit('<a href="https://medium.com/p/'), d.cast("string"), F.lit('">more</a>'),
            F.lit('<a href="https://links.beehiiv.com/a/b">sponsored placement</a>'),
            F.lit('<a href="https://example.com/unsubscribe?u=1">unsubscribe from this</a></p></article>'))
        src = F.col("source")
        sender = (F.when(d % 4 == 0, F.concat(F.lit('"'), src, F.lit(' Daily" <'), F.upper(src), F.lit("@example.com>")))
                  .when(d % 4 == 1, F.concat(src, F.lit(" Weekly <"), src, F.lit("@example.com>")))
                  .when(d % 4 == 2, F.concat(src, F.lit("@example.com")))
                  .otherwise(F.concat(F.lit("<"), src, F.lit("@example.com>"))))
        labels = F.split(F.concat_ws(",", F.lit("UPDATES"), F.when(d % 3 != 0, F.lit("UNREAD")),
                                     F.when(d % 5 != 0, F.lit("IMPORTANT"))), ",")
        text = F.col("text")
        tasks = self.parallelism or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        out = spread(docs, "doc_id", tasks).join(lk, "doc_id").select(
            d.cast("string").alias("id"),
            d.alias("ord"),
            F.replace(F.substring(text, 1, 80), F.lit("\n"), F.lit(" ")).alias("subject"),
            sender.alias("sender"),
            (F.lit(EPOCH0) + d * SECONDS_PER_DOC).alias("received_epoch"),
            labels.alias("label_ids"),
            F.when(d % 10 == 0, F.lit("")).otherwise(
                F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(" "))).alias("snippet"),
            F.when(d % 6 == 0, F.lit("")).otherwise(
                F.replace(F.col("html"), F.lit("</article>"), links)).alias("body_html"),
            text.alias("body_text"),
        )
        self._cache["messages"] = out
        return out

    # -- verdicts -------------------------------------------------------
    def verdicts(self) -> DataFrame:
        """verdicts(id, ord, category, relevance_score, topics, reason)."""
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        labels = self.table("labels").select(F.col("doc_id").alias("l_doc_id"), "quality", "toxic")
        j = (docs.join(labels, F.col("doc_id") == F.col("l_doc_id"), "left")
             .select("doc_id", "lang", "source", "n_chars", "quality", "toxic",
                     F.col("l_doc_id").isNull().alias("_missing")))
        d = F.col("doc_id")
        missing = F.col("_missing")
        return j.select(
            d.cast("string").alias("id"),
            d.alias("ord"),
            F.when(missing | (F.col("toxic") == 1), F.lit("discard"))
             .when(F.col("quality") == 1, F.lit("high_relevance"))
             .otherwise(F.lit("general_info")).alias("category"),
            F.when(missing, F.lit(0.0)).otherwise((F.col("n_chars") % 101).cast("double") / 100).alias("relevance_score"),
            F.split(F.concat_ws(",", F.col("lang"), F.when(d % 2 == 0, F.col("source"))), ",").alias("topics"),
            F.when(missing, F.lit("missing from model output")).otherwise(F.lit("labelled")).alias("reason"),
        )

    # -- state ----------------------------------------------------------
    def processed_messages(self) -> DataFrame:
        """processed_messages(message_id, processed_epoch)."""
        d = F.col("doc_id")
        return (self.table("documents").where(d % 7 == 0)
                .select(d.cast("string").alias("message_id"), (F.lit(EPOCH0) + d * SECONDS_PER_DOC).alias("processed_epoch")))

    def runs(self) -> DataFrame:
        """runs(id, ran_epoch, messages_processed)."""
        return self.spark.createDataFrame(RUN_LOG, "id long, ran_epoch long, messages_processed long")

    def pages(self) -> DataFrame:
        return self.table("pages")


def load(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


# ---------------------------------------------------------------------------
# Replayed model output for triage batches
# ---------------------------------------------------------------------------

REPLAY_MODES = 19   # batch_id % 19 picks how the recorded output is shaped


def replay_responses(batched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Model output per triage batch, replayed from the verdicts view.

    Each batch's output is the JSON array of its rows' verdicts, shaped by
    ``batch_id % 19`` into every case the reader must handle: valid (0),
    a null score (1), a non-numeric score (2), boolean and string scores (3),
    code fence (4), truncated JSON (5), empty text (6), failed call (7),
    short array (8), long array (9), ``[]`` (10), ``{}`` (11), non-empty
    object (12), element that is not an object (13), missing keys / null
    and unknown category (14), trailing text after the array (15), a second
    array in it (16) or right behind the first (17), two objects (18).
    Output: (batch_id, n_emails, response).
    """
    j = batched.select("id", "batch_id", "idx").join(
        verdicts.select("id", "category", "relevance_score", "topics", "reason"), "id")
    mode = F.col("batch_id") % REPLAY_MODES
    idx = F.col("idx")
    opts = {"ignoreNullFields": "false"}

    def obj(category, score, with_rest: bool = True) -> Column:
        fields = [category.alias("category")]
        if with_rest:
            fields += [score.alias("relevance_score"), F.col("topics"), F.col("reason")]
        return F.to_json(F.struct(*fields), opts)

    cat, score = F.col("category"), F.col("relevance_score")
    element = (F.when((mode == 1) & (idx == 1), obj(cat, F.lit(None).cast("double")))
               .when((mode == 2) & (idx == 1), obj(cat, F.lit("abc")))
               .when((mode == 3) & (idx == 1), obj(cat, F.lit(True)))
               .when((mode == 3) & (idx == 2), obj(cat, score.cast("string")))
               .when((mode == 13) & (idx == 1), F.lit('"oops"'))
               .when((mode == 14) & (idx == 1), obj(cat, score, with_rest=False))
               .when((mode == 14) & (idx == 2), obj(F.lit(None).cast("string"), score))
               .when((mode == 14) & (idx == 3), obj(F.lit("newsletter"), score))
               .otherwise(obj(cat, score)))
    per_batch = j.select("batch_id", "idx", element.alias("el")).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_emails"),
        F.sort_array(F.collect_list(F.struct("idx", "el"))).alias("els"))
    n = F.col("n_emails")
    kept_els = F.when((F.col("batch_id") % REPLAY_MODES) == 8,
                      F.filter("els", lambda e: e["idx"] <= n - 3)).otherwise(F.col("els"))
    arr = F.concat(F.lit("["), F.array_join(F.transform(kept_els, lambda e: e["el"]), ","),
                   F.when((F.col("batch_id") % REPLAY_MODES) == 9, F.lit(',{"category":"discard"}'))
                   .otherwise(F.lit("")), F.lit("]"))
    m = F.col("batch_id") % REPLAY_MODES
    a = F.col("_arr")
    response = (F.when(m == 4, F.concat(F.lit("```json\n"), a, F.lit("\n```")))
                .when(m == 5, F.substring(a, F.lit(1), F.length(a) - 7))
                .when(m == 6, F.lit(""))
                .when(m == 7, F.lit(None).cast("string"))
                .when(m == 10, F.lit("[]"))
                .when(m == 11, F.lit("{}"))
                .when(m == 12, F.concat(F.lit('{"verdicts":'), a, F.lit("}")))
                .when(m == 15, F.concat(a, F.lit(" trailing words")))
                .when(m == 16, F.concat(a, F.lit(" see [1]")))
                .when(m == 17, F.concat(a, F.lit("[]")))
                .when(m == 18, F.lit("{} and {}"))
                .otherwise(a))
    return per_batch.select("batch_id", "n_emails", arr.alias("_arr")).select(
        "batch_id", "n_emails", response.alias("response"))


# ---------------------------------------------------------------------------
# Raw message payloads (the mail API's JSON form) derived from the messages view
# ---------------------------------------------------------------------------


def _b64url(text: Column) -> Column:
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def _node(mime: str, data: Column | None = None, parts: Column | None = None) -> Column:
    leaf_t = "array<struct<mimeType:string,body:struct<data:string>>>"
    return F.struct(F.lit(mime).alias("mimeType"),
                    (F.struct(data.alias("data")) if data is not None else F.lit(None).cast("struct<data:string>"))
                    .alias("body"),
                    (parts if parts is not None else F.lit(None).cast(leaf_t)).alias("parts"))


WRAPPERS = 12


def raw_payloads(messages: DataFrame) -> DataFrame:
    """(id, ord, payload_json): each message as the mail API returns it.

    Shapes by ``ord``: a multipart/alternative (text + html unless the HTML is
    empty) inside multipart/mixed; a duplicate, differently-cased Subject
    header on every 5th (last one wins); an attachment on every 4th; a second
    text part (a footer) on every 3rd; headers missing on every 50th (+7); the
    whole tree wrapped into twelve more multiparts on every 40th (+9).
    """
    o = F.col("ord")
    date = F.date_format(F.timestamp_seconds(F.col("received_epoch")), "EEE, dd MMM yyyy HH:mm:ss '+0000'")

    def header(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.concat(
        F.array(header("Subject", F.col("subject")), header("From", F.col("sender")), header("Date", date)),
        F.when(o % 5 == 0, F.array(header("SUBJECT", F.concat(F.lit("Re: "), F.col("subject")))))
        .otherwise(F.array().cast("array<struct<name:string,value:string>>")))
    leaf = lambda mime, text: F.struct(F.lit(mime).alias("mimeType"),
                                       F.struct(_b64url(text).alias("data")).alias("body"))
    alt_parts = F.when(F.col("body_html") != "", F.array(leaf("text/plain", F.col("body_text")),
                                                         leaf("text/html", F.col("body_html")))) \
        .otherwise(F.array(leaf("text/plain", F.col("body_text"))))
    alt = _node("multipart/alternative", parts=alt_parts)
    attach = _node("application/pdf", data=F.lit("JVBERi0xLjQK"))
    footer = _node("text/plain", data=_b64url(F.concat(F.lit("-- sent to reader "), F.col("id"))))
    node_t = "array<struct<mimeType:string,body:struct<data:string>," \
             "parts:array<struct<mimeType:string,body:struct<data:string>>>>>"
    empty = F.array().cast(node_t)
    parts = F.concat(F.array(alt), F.when(o % 4 == 0, F.array(attach)).otherwise(empty),
                     F.when(o % 3 == 0, F.array(footer)).otherwise(empty))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"),
                       F.when(o % 50 != 7, headers).alias("headers"), parts.alias("parts"))
    msg = F.struct(F.col("snippet").alias("snippet"), payload.alias("payload"))
    plain = F.to_json(msg)
    own = F.to_json(parts)      # stands once in the payload, as the value of its "parts"
    deep = F.replace(plain, own, F.concat(F.lit('[{"mimeType":"multipart/mixed","parts":' * WRAPPERS), own,
                                          F.lit("}]" * WRAPPERS)))
    return messages.select("id", "ord", F.when(o % 40 == 9, deep).otherwise(plain).alias("payload_json"))
