"""Keyword rules: one automaton against regular expressions and plain search."""

import random
import re

from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.operators import keyword_rules as KR
from sifter.operators import triage as TR


def random_texts(n=1500):
    rng = random.Random(8)
    words = [w if isinstance(w, str) else w[0] for _, own in TR.RUBRIC_KEYWORDS for w in own] + [
        "bill", "schedule", "Health", "HEALTHbill", "12% off", "% off", "AI orchestration", "x" * 21, "plain", "words", "İ", "é", "\n", "tracking", "number"]
    return [rng.choice([" ", "", "  "]).join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words[-15:] if rng.random() < 0.8 else words)
                                             for _ in range(rng.randint(0, 6))) for _ in range(n)] + ["", None]


def test_rubric_equals_its_patterns(spark):
    """The keyword table says what the regular expressions of the rubric say, for every random text."""
    texts, cfg = random_texts(), DigestConfig()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.rule for r in KR.first_rules(df, TR.rubric_rules(spark, cfg), ["i"]).collect()}
    patterns = [(n, re.compile(f"(?ia:{p})")) for n, p in TR.RUBRIC_DISCARD_RULES] + [("topic", re.compile(TR.topic_pattern(cfg)))]
    expect = {i: next((n for n, p in patterns if p.search(t or "")), None) for i, t in enumerate(texts)}
    assert got == expect and len(set(expect.values())) > 15


def test_a_thousand_rules_in_one_pass(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(1000)]
    rows = [(f"r{i % 400}", i % 400, w, None, None) for i, w in enumerate(words)] + [("pair", -1, "ab", "cd", 3), ("none", -5, "", None, None)]
    texts = ["".join(rng.choice("abcde \n") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, text string, rule string")
    out = KR.first_rules(df, spark.createDataFrame(rows, KR.RULES_SCHEMA), ["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
    for r in out.collect():
        t = texts[r.i]
        hits = {(p, n) for n, p, k, then, w in rows if k and then is None and k in t}
        if re.search("ab.{0,3}cd", t):
            hits.add((-1, "pair"))
        assert (r.rule, r.n_rules) == (min(hits)[1] if hits else None, len(hits)), t


def test_more_rules_and_limits(spark, monkeypatch):
    cfg = DigestConfig()
    m = spark.createDataFrame([("1", 1, "Zebra news", "a", "s", "b"), ("2", 2, "invoice and zebra", "a", "s", "b")],
                              "id string, ord long, subject string, sender string, snippet string, body_text string")
    more = spark.createDataFrame([("animals", 500, "zebra", None, None)], KR.RULES_SCHEMA)
    got = {r.id: (r.category, r.rule) for r in TR.rubric_label(m, cfg, TR.rubric_rules(spark, cfg, more)).collect()}
    assert got == {"1": ("discard", "animals"), "2": ("discard", "receipt")}
    assert TR.rubric_label(m.limit(0), cfg).count() == 0
    assert KR.first_rules(m.select("id", F.col("subject").alias("text")), more.limit(0), ["id"]).where("rule IS NULL").count() == 2
    monkeypatch.setattr(KR, "MAX_ROWS", 3)
    try:
        TR.rubric_label(m, cfg)
        raise AssertionError("a table beyond the bound must be refused")
    except ValueError:
        pass
