"""Property checks on random inputs, evaluated in one Spark job per example batch."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import col_values
from sifter.config import DigestConfig
from sifter.functions import constants as K
from sifter.functions import text as T
from sifter.operators import triage as TR

SPACES = "".join(chr(c) for c in K.STRIP_CODEPOINTS)
INVISIBLE = "".join(chr(c) for c in K.INVISIBLE_CODEPOINTS)
alphabet = st.sampled_from(list(SPACES + INVISIBLE + "ab<>@\"é😀​-") )
texts = st.lists(st.text(alphabet=alphabet, max_size=12) | st.text(max_size=12), min_size=20, max_size=40)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(texts)
def test_strip_matches_python(spark, values):
    assert col_values(spark, T.py_strip, values) == [v.strip() for v in values]


@SETTINGS
@given(texts)
def test_invisible_deletion(spark, values):
    expect = ["".join(c for c in v if c not in INVISIBLE) for v in values]
    assert col_values(spark, T.strip_invisible, values) == expect


@SETTINGS
@given(texts)
def test_word_pieces_are_lossless(spark, values):
    pieces = col_values(spark, T.word_pieces, values)
    assert ["".join(p) for p in pieces] == values


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["discard", "high_relevance", "general_info", "other", None]),
                          st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=True, width=32))),
                min_size=10, max_size=40))
def test_kept_and_discarded_partition_the_input(spark, rows):
    df = spark.createDataFrame([(str(i), i, c, None if s is None else float(s)) for i, (c, s) in enumerate(rows)],
                               "id string, ord long, category string, relevance_score double")
    kept = {r.id for r in TR.keep_filter(df, DigestConfig()).collect()}
    discarded = {r.id for r in TR.id_complement(df, TR.keep_filter(df, DigestConfig())).collect()}
    assert kept | discarded == {str(i) for i in range(len(rows))} and not kept & discarded
    flags = {r.id: r.kept for r in TR.split_kept_discarded(df, DigestConfig()).collect()}
    assert {i for i, k in flags.items() if k} == kept
