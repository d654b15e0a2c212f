"""Operator 1 (native): SpotSigs document fingerprints.

A signature is an anchor (a common word) with the chain of ``CHAIN`` content words
that follow it; the fingerprint of a text is the sorted set of its signatures (as
32-bit hashes).  A fingerprint is compared by Jaccard similarity with that of the
text's edited form and that of the next document, with nothing else; the length
partition is an output column that no comparison uses.
Everything is DataFrame expressions over arrays within a row; only the order of the ids, the text that
the next document lends, and its fingerprint are shuffled.

Defined cases: null text is the empty text; a text without any signature has its
words as signatures, the empty text has none; equal fingerprints have likeness 1,
also two empty ones.  Documents are ordered by descending doc_id, a null doc_id
last; rows that repeat a doc_id are all returned, and lend the smallest of their texts to the
document before; a lone document is followed by itself.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.llm.common import stored

CHAIN = 2
#: Lengths of one partition lie within this likeness of each other.
PARTITION_LIKENESS = 0.8
LAST_ID = -(1 << 63)

# ---- fixed values: common words of English, German, French and Spanish
ANCHORS = ("the of and to a in is that it for was on are with as be at by an this from "
           "der die das und zu den von mit ist des im für auf dem nicht ein eine als auch sich "
           "le la les de du et un une en est que qui dans pour au sur pas par avec "
           "el los las del y es se por con para su al lo como no una").split()


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted signatures of the column ``text`` in ``out`` (array<int>)."""
    words, content, heads = f"_{out}_words", f"_{out}_content", f"_{out}_heads"
    w, p = F.col(words), F.col(content)
    get = lambda a, i: F.get(a, i)
    df = df.withColumn(words, F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), "[^\\p{L}\\p{N}]+"))
    # places of the content words, and of those that come right after an anchor
    df = df.withColumn(content, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~get(w, i).isin("", *ANCHORS)))
    df = df.withColumn(heads, F.when(F.size(p) >= chain, F.filter(
        F.sequence(F.lit(0), F.size(p) - chain),
        lambda k: (get(p, k) > 0) & (get(p, k) - F.coalesce(get(p, k - 1), F.lit(-1)) > 1) & (get(w, get(p, k) - 1) != "")))
        .otherwise(F.array().cast("array<int>")))
    chains = F.transform(heads, lambda k: F.hash(get(w, get(p, k) - 1), *[get(w, get(p, k + j)) for j in range(chain)]))
    plain = F.transform(F.filter(w, lambda x: x != ""), lambda x: F.hash(x))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.when(F.size(heads) > 0, chains).otherwise(plain))))
    return df.drop(words, content, heads)


def length_partition(signatures, likeness: float = PARTITION_LIKENESS) -> Column:
    """Partition of a set by its length: sets within ``likeness`` are in one or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / -math.log(likeness) + 1e-9).cast("int")


def likeness(a, b, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a comparison where the lengths keep it below ``least``
    (with ``least`` 0: where one of them is empty)."""
    a, b = F.col(a), F.col(b)
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (F.when(a == b, 1.0).when((small == 0) | (small < least * large), 0.0)
            .otherwise(common / (F.size(a) + F.size(b) - common)))


def lent_heads(docs: DataFrame) -> DataFrame:
    """(key, target, need): for each document the one before it in descending order, which it
    follows, and how many characters it lends it.

    Only ids and lengths are sorted: range partitions, neighbours within each by a window, and one row
    for each partition to link their ends."""
    ids = docs.groupBy("key").agg(F.max("n_chars").alias("n"))
    ranged = stored(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "spotsigs-ids")
    above = Window.partitionBy("part").orderBy("key")
    ends = ranged.groupBy("part").agg(F.min(F.struct("key", "n")).alias("lowest"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("lowest").over(order), F.first("lowest").over(order)).alias("beyond"))
    linked = ranged.withColumn("above", F.lead(F.struct("key", "n")).over(above)).join(F.broadcast(ends), "part")
    upper = F.coalesce("above", "beyond")
    return linked.select("key", upper["key"].alias("target"), F.floor(upper["n"] / 2).cast("int").alias("need"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    length_partition) of every row of (doc_id, text): the text's own fingerprint, that of its edited
    form (the second half replaced by the start of the next document), and their likeness."""
    # both joins below take these three columns by key, so one shuffle of the texts serves both
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_chars = F.char_length("text").cast("long")
    lending = rows.join(lent_heads(rows.select("key", n_chars.alias("n_chars"))), "key")
    first = Window.partitionBy("key", "doc_id").orderBy("text")
    lending = lending.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    lending = with_signatures(lending, "text", "next_sigs").select(
        F.col("target").alias("key"), F.substring("text", F.lit(1), F.col("need")).alias("lent"), "next_sigs")
    both = rows.join(lending, "key").withColumn("n_chars", n_chars)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                                              F.substring("lent", F.lit(1), half))).drop("lent")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    both = with_signatures(with_signatures(both, "text", "sigs").drop("text"), "edited", "edited_sigs")
    return both.select("doc_id", "n_chars", "edited_sha256", F.col("sigs").cast("string").alias("fingerprint"),
                       F.col("edited_sigs").cast("string").alias("edited_fingerprint"),
                       likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
                       length_partition("sigs").alias("length_partition"))
