"""Verdict reading truth table, keep rule, caps, batching, model UDF."""

import json

import pytest
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.functions.models import failing_model, rubric_model
from sifter.operators import triage as TR
from sifter.operators.ordering import ordered_position

OBJ = '{"category":"high_relevance","relevance_score":0.9,"topics":["ai"],"reason":"r"}'


def _verdicts(spark, response, n=3):
    batched = spark.createDataFrame([(f"m{i}", i, 0, i + 1) for i in range(n)], "id string, ord long, batch_id long, idx int")
    resp = spark.createDataFrame([(0, n, response)], "batch_id long, n_emails long, response string")
    rows = TR.positional_verdicts(batched, resp).orderBy("idx").collect()
    return [(r.category, r.relevance_score, r.topics, r.reason) for r in rows]


FAILED = ("general_info", 0.5, [], "Triage failed; defaulting to general_info")
BAD = ("discard", 0.0, [], "JSON parse failed; defaulting to discard")
MISSING = ("discard", 0.0, [], "Missing from model output; defaulting to discard")
GOOD = ("high_relevance", 0.9, ["ai"], "r")


@pytest.mark.parametrize("response,expect", [
    (f"[{OBJ},{OBJ},{OBJ}]", [GOOD] * 3),                                 # valid
    (f"```json\n[{OBJ},{OBJ},{OBJ}]\n```", [GOOD] * 3),                   # fenced
    (f"[{OBJ},{OBJ}", [BAD] * 3),                                         # truncated
    ("", [BAD] * 3),                                                      # empty text
    (None, [FAILED] * 3),                                                 # call failed
    (f"[{OBJ}]", [GOOD, MISSING, MISSING]),                               # short array
    (f"[{OBJ},{OBJ},{OBJ},{OBJ}]", [GOOD] * 3),                           # long array
    ("[]", [MISSING] * 3),
    ("{}", [MISSING] * 3),
    ('""', [MISSING] * 3),
    ('{"a": 1}', [FAILED] * 3),                                           # non-empty object
    ("42", [FAILED] * 3),                                                 # scalar
    ("null", [FAILED] * 3),
    (f'[{OBJ},"x",{OBJ}]', [FAILED] * 3),                                 # element not an object
    (f"[{OBJ}] trailing", [BAD] * 3),                                     # trailing junk
])
def test_batch_failure_rules(spark, response, expect):
    assert _verdicts(spark, response) == expect


def test_element_field_rules(spark):
    els = ['{"relevance_score":"0.7"}', '{"relevance_score":true}', '{}', '{"category":null,"relevance_score":0.6}',
           '{"category":"newsletter","topics":null,"reason":null}']
    got = _verdicts(spark, "[" + ",".join(els) + "]", n=5)
    assert got == [("general_info", 0.7, [], ""), ("general_info", 1.0, [], ""), ("general_info", 0.5, [], ""),
                   (None, 0.6, [], ""), ("newsletter", 0.5, None, None)]


@pytest.mark.parametrize("score", ['null', '"abc"', '[1]', '{"a":1}'])
def test_unreadable_score_fails_the_whole_batch(spark, score):
    resp = f'[{OBJ},{{"category":"general_info","relevance_score":{score}}}]'
    assert _verdicts(spark, resp, n=2) == [FAILED] * 2


def test_keep_rule_nulls_and_nan(spark):
    rows = [("discard", 0.9), ("high_relevance", 0.3), ("weird", 0.5), (None, 0.5), ("general_info", float("nan")),
            ("general_info", None)]
    df = spark.createDataFrame(rows, "c string, s double")
    got = [r[0] for r in df.select(TR.keep_flag(F.col("c"), F.col("s"), 0.5)).collect()]
    assert got == [False, False, True, True, False, False]


def test_top_n_per_sender_stable_ties(spark):
    rows = [(f"i{k}", k, "s", 0.9 if k < 5 else 0.5) for k in range(8)] + [("z", 99, "t", 0.1)]
    df = spark.createDataFrame(rows, "id string, ord long, sender_key string, relevance_score double")
    got = TR.top_n_per_sender(df, 3).orderBy("sender_key", "sender_rank").select("id").collect()
    assert [r.id for r in got] == ["i0", "i1", "i2", "z"]


def test_ordered_position_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("ord"),
                                                      (F.col("id") % 3).alias("g"))
    pos = ordered_position(df, ["ord"]).orderBy("ord").select("pos").collect()
    assert [r.pos for r in pos] == list(range(1, 5001))
    gpos = ordered_position(df, ["ord"], ["g"]).collect()
    by_g = {}
    for r in sorted(gpos, key=lambda r: (r.g, r.ord)):
        by_g.setdefault(r.g, []).append(r.pos)
    assert all(v == list(range(1, len(v) + 1)) for v in by_g.values())


def test_assign_batches_and_pack(spark):
    m = spark.createDataFrame([(str(i), i * 3, f"s{i}", f"a{i}@x", "", "body") for i in range(45)],
                              "id string, ord long, subject string, sender string, snippet string, body_text string")
    b = TR.assign_batches(TR.triage_input(m))
    counts = {r.batch_id: r.n for r in b.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 20, 1: 20, 2: 5}
    p = TR.batch_pack(b, DigestConfig()).where("batch_id = 2").first()
    assert p.prompt.startswith("Classify the following 5 email(s):\n\n--- Email 1 ---\nSubject: s40\nFrom: a40@x\n")


def test_model_udf_paths(spark):
    m = spark.createDataFrame([(str(i), i, f"Your password reset {i}" if i % 2 else f"AI orchestration news {i}",
                                "a@x", "", "b") for i in range(30)],
                              "id string, ord long, subject string, sender string, snippet string, body_text string")
    b = TR.assign_batches(TR.triage_input(m))
    packed = TR.batch_pack(b, DigestConfig())
    ok = TR.positional_verdicts(b, TR.score_batches(packed, rubric_model())).orderBy("ord").collect()
    native = TR.rubric_label(m, DigestConfig()).orderBy("ord").collect()
    assert [(r.category, r.relevance_score) for r in ok] == [(r.category, r.relevance_score) for r in native]
    assert {r.category for r in ok} == {"discard", "high_relevance"}
    failed = TR.positional_verdicts(b, TR.score_batches(packed, failing_model)).collect()
    assert {(r.category, r.relevance_score) for r in failed} == {("general_info", 0.5)}
    assert json.loads(rubric_model()("", "--- Email 1 ---\nSubject: hi\nFrom: a\nPreview: p\n---"))[0]["category"] \
        == "general_info"
