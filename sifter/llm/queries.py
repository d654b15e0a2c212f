"""The queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm import backoff_lm, decontam, html_density, langid, license_join, minhash_tensor, path_repair, piece_codec, prefix_trie, spotsigs
from sifter.llm.bpe_codec import encode_decode
from sifter.llm.common import held_out, prepare, table
from sifter.llm.token_counts import count_tokens
from sifter.llm.token_file import token_digest


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(prepare(spark), sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return backoff_lm.score_texts(docs, ~held_out(F.col("doc_id"), 7, 2))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    return langid.predictions(docs, langid.dictionaries(docs, ~out)).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_tensor.near_duplicates(table(prepare(spark), sf_dir, "documents"), shingle=2, percent=80)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(prepare(spark), sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(prepare(spark), sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(prepare(spark), sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(prepare(spark), sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(prepare(spark), table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(prepare(spark), sf_dir, "conversations"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_pieces(table(prepare(spark), sf_dir, "documents"))


def op13_path_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_repair.repair_conversations(table(prepare(spark), sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_spotsigs, op2_language_model, op3_language_id, op4_near_duplicates, op5_decontamination, op6_html_text, op7_token_counts, op8_bpe,
        op9_license_scan, op10_token_file, op11_prefix_trie, op12_sentencepiece, op13_path_repair)}


def oracle_sql() -> dict[str, str]:
    return {}
