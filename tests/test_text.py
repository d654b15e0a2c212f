"""Hand-written cases for the scalar text functions."""

from pyspark.sql import functions as F

from conftest import col_values, one
from sifter.functions import constants as K
from sifter.functions import text as T


def test_normalize_sender_forms(spark):
    got = col_values(spark, T.normalize_sender,
                     ['"Name" <A@b.c>', "Name <a@b.c>", "a@b.c", "<a@b.c>", " <a@b.c>", "", "  X@Y.Z 　"])
    assert got == ["a@b.c", "a@b.c", "a@b.c", "a@b.c", "a@b.c", "", "x@y.z"]


def test_source_name_forms(spark):
    got = col_values(spark, T.source_name,
                     ['"Name" <A@b.c>', "Name <a@b.c>", "a@b.c", "<a@b.c>", " <a@b.c>", "", "Plain"])
    # "<a@b.c>" has no display name: the text before "@" is kept; " <a@b.c>" strips to ''
    assert got == ["Name", "Name", "a", "<a", "", "", "Plain"]


def test_strip_invisible_deletes_each_code_point(spark):
    values = [f"a{chr(c)}b" for c in K.INVISIBLE_CODEPOINTS]
    assert col_values(spark, T.strip_invisible, values) == ["ab"] * len(values)
    # NBSP is deleted, so the words merge
    assert one(spark, T.strip_invisible(F.col("x")), "two words") == "twowords"


def test_py_strip_is_python_strip(spark):
    samples = ["  a b  ", "　 x ", "\x1c\x1fy\x1d", "​z​", "", "\t\n\r\x0b\x0c q \x85"]
    assert col_values(spark, T.py_strip, samples) == [s.strip() for s in samples]


def test_preview_and_truncation(spark):
    df = spark.createDataFrame([("", "x" * 700), ("snip", "body"), ("😀" * 700, "")], "s string, b string")
    got = [r[0] for r in df.select(T.preview_text("s", "b")).collect()]
    assert got == ["x" * 600, "snip", "😀" * 600]          # code points, not bytes
    assert one(spark, T.truncate_ellipsis(F.col("x"), 5), "abcdef") == "abcde..."
    assert one(spark, T.truncate_ellipsis(F.col("x"), 5), "abcde") == "abcde"
    assert one(spark, T.truncate_ellipsis(F.col("x"), 5, always=True), "abc") == "abc..."


def test_strip_code_fence(spark):
    cases = ['```json\n[1]\n```', '  ```\n[2]\n```  ', "```", "```json\n[3]", "[4]"]
    expect = ["[1]", "[2]", "", "", "[4]"]
    assert col_values(spark, T.strip_code_fence, cases) == expect


def test_word_pieces_lossless_and_counts(spark):
    samples = ["", "one", "  lead two", "a  b\n\nc ", "\t"]
    pieces = col_values(spark, T.word_pieces, samples)
    assert ["".join(p) for p in pieces] == samples
    assert [len(p) for p in pieces] == [0, 1, 3, 3, 1]
