"""The registered queries of the training-data operators."""

import re

import __spark_entry__ as E
from sifter.llm import queries


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", k)[1]) for k in queries.queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(E.queries())


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    wanted = {
        "op1_spotsigs": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op2_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op4_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
        "op5_decontamination": ["doc_id", "item_id"],
        "op6_html_text": ["page_id", "url", "text", "n_chars"],
        "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op10_token_file": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
        "op12_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13_path_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]}
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    n["conversations"] = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    of = {"op6_html_text": "pages", "op13_path_repair": "conversations"}
    for name, query in queries.queries().items():
        df = query(spark, sf)
        assert df.columns[:len(wanted[name])] == wanted[name]
        if name not in ("op5_decontamination", "op11_prefix_trie"):
            assert df.count() == n[of.get(name, "documents")]
