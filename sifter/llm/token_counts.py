"""Operator 7: token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus' frequent pre-tokens and their token
counts, broadcast to every task; its size is bounded by ``FREQUENT``.  Tier two
is a cache in each Python worker: pre-tokens that tier one misses are encoded
once by the tokenizer library, in batches, and remembered up to ``CACHE``.
Texts never move: no pre-token of a text is shuffled, only bounded summaries
(at most ``SUMMARY`` heavy pre-tokens of each task) meet to build tier one.  The
tiers change the cost only; every count is the library's.

Defined cases: null or empty text has 0 tokens; repeated rows give repeated
rows; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import kept, load_tokenizer

#: Entries of the broadcast table (a few MB), of each task's summary and of a worker's cache.
FREQUENT = 50_000
SUMMARY = 2_000
CACHE = 300_000

#: Unicode White_Space, and the pre-token pattern of the byte-level vocabulary.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BYTE_LEVEL = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
              rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class PreTokens:
    """Splits a text into library pre-tokens; strings of special tokens count as the library's default does."""

    def __init__(self, name: str):
        import regex

        self.tok = load_tokenizer(name)
        self.find = regex.compile(BYTE_LEVEL).findall
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = special
        self.lengths: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special tokens."""
        if self.special is None or not any(m in text for m in self.marks):
            return self.find(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.find(p)], len(parts) - 1


def _pre_tokens(name: str) -> PreTokens:
    return kept(("pre-tokens", name), lambda: PreTokens(name))


def frequent_pre_tokens(docs: DataFrame, name: str, frequent: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The pre-tokens that are heavy over all texts: each task counts all of its
    texts, keeping a bounded summary; the summaries are added up and the ``frequent``
    largest sums are taken (the driver receives at most that many)."""

    def summarise(batches):
        pre, seen = _pre_tokens(name), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(pre.split(text)[0])
            if len(seen) > 100 * summary:
                seen = Counter(dict(seen.most_common(50 * summary)))
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in top], pa.string()),
                                          "n": pa.array([n for _, n in top], pa.int64())})

    sums = docs.select("text").mapInArrow(summarise, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r["token"] for r in sums.orderBy(F.desc("n"), "token").limit(frequent).collect()]


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024,
                 frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    heavy = frequent_pre_tokens(docs, name, frequent)
    tok = load_tokenizer(name)
    lengths = {t: len(e.ids) for t, e in zip(heavy, tok.encode_batch_fast(heavy, add_special_tokens=False))}
    first_tier = sc.broadcast(lengths)

    def count(batches):
        pre, tier1 = _pre_tokens(name), first_tier.value
        known = pre.lengths
        for b in batches:
            split = [pre.split(t) if t else ((), 0) for t in b.column(1).to_pylist()]
            if len(known) > CACHE or not known:
                known.clear()
                known.update(tier1)
            missing = list(set().union(*(s for s, _ in split)).difference(known))
            known.update(zip(missing, map(len, pre.tok.encode_batch_fast(missing, add_special_tokens=False))))
            look = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([sum(map(look, s)) + n for s, n in split], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").select(
        "*", (F.col("n_tokens") > limit).alias("over_limit"))
