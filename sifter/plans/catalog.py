"""Registry of named queries: a Spark builder and (where SQL can say it) a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.plans import oracle as O
from sifter.sources.fixtures import Fixtures, load
from sifter.session import apply_required

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

CFG = DigestConfig()


def register(key: str, oracle: str | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]) -> Builder:
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_required(spark)
            return fn(load(spark, sf_dir))
        build.__name__ = key
        build.__doc__ = fn.__doc__
        REGISTRY[key] = build
        if oracle is not None:
            ORACLE[key] = oracle
        return build
    return deco


def queries() -> dict[str, Builder]:
    _import_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    _import_all()
    return dict(ORACLE)


def _import_all() -> None:
    # Importing the modules registers their queries.
    from sifter.plans import (  # noqa: F401
        q_triage, q_text, q_links, q_extract, q_digest, q_state, q_mime, q_streaming, q_udf)
