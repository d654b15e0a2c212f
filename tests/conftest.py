import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sifter.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def one(spark, expr_col, value=None, schema="x string"):
    """Evaluate a Column expression on a one-row frame holding ``value`` in column x."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("r")).first()["r"]


def col_values(spark, fn, values, schema="x string"):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["r"] for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]
