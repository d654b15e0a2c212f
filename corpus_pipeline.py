"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, BPE encoding.

Each stage takes all rows its predecessor kept, is written as Parquet and read
again for the next one.  Stages but the last return the columns of ``documents``.
SQL cannot express compression, MinHash, alignment or BPE, so there is no oracle
statement; the stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import decontam, langid, minhash_tensor
from sifter.llm.bpe_codec import encode_decode
from sifter.llm.common import prepare, stored, table


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, trained on the labelled rows of its input; documents that it rejects go."""
    prepare(spark)
    return langid.keep_recognised(docs, langid.dictionaries(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on shingles of five words, similarity 0.8; the smallest doc_id of a group stays."""
    prepare(spark)
    return minhash_tensor.keep_one_of_each(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 against the whole ``benchmark`` table; documents that hold an item go."""
    return decontam.keep_clean(docs, table(prepare(spark), sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: number of tokens, and digests of the ids and of the decoded text."""
    prepare(spark)
    return encode_decode(docs)


STAGES = [("language_id", recognise_language), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_benchmark_leaks), ("bpe", encode_tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
