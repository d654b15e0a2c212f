"""Registered user-function queries (U3, U6): Python runs only inside Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.functions import constants as K
from sifter.functions.models import counting_model, failing_model, rubric_model
from sifter.functions.templates import sql_fill
from sifter.operators import digest as D
from sifter.operators import triage as TR
from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.plans.q_digest import ITEM_CTES, SQL_CAPPED, SQL_FALLBACK
from sifter.plans.q_digest import capped as capped_items
from sifter.plans.q_digest import sql_item_block
from sifter.plans.q_triage import _sql_rubric, batched
from sifter.session import stored
from sifter.sources.fixtures import Fixtures


@register("score_batches", O.compose([("rub", _sql_rubric())],
    "SELECT id, category, relevance_score, rule AS reason FROM rub"))
def q_score_batches(fx: Fixtures) -> DataFrame:
    """Every batch prompt scored by a model callable (here the offline rubric model),
    its JSON read back natively (F12/F13/J3)."""
    b = batched(fx)
    responses = TR.score_batches(TR.batch_pack(b, CFG), rubric_model(CFG))
    v = TR.positional_verdicts(b.select("id", "ord", "batch_id", "idx"), responses)
    return v.select("id", "category", "relevance_score", "reason")


@register("write_digest", O.compose([*ITEM_CTES, SQL_CAPPED, SQL_FALLBACK], f"""
SELECT 'failing' AS model, n_items, fallback_md AS digest_md FROM fb
UNION ALL
SELECT 'counting', count(*), concat('## Digest', chr(10), count(*), ' items, ', length({sql_fill(
    K.SYNTHESIS_USER, items_block=f"string_agg({sql_item_block()}, chr(10) ORDER BY priority, ord)")}), ' characters')
FROM capped_i"""))
def q_write_digest(fx: Fixtures) -> DataFrame:
    """The synthesis call on the capped items' prompt, by a model that answers and by one that
    fails (then F17's fallback is the digest)."""
    parts = stored(D.digest_parts(capped_items(fx)), "digest-parts")
    prompt = parts.select("n_items", "fallback_md", D.synthesis_prompt(F.col("items_block")).alias("prompt"))
    digest = F.coalesce("model_md", "fallback_md").alias("digest_md")
    return D.write_digest(prompt, failing_model).select(F.lit("failing").alias("model"), "n_items", digest).unionByName(
        D.write_digest(prompt, counting_model).select(F.lit("counting").alias("model"), "n_items", digest))
