"""One digest run as a DataFrame graph (the `run` command).

cutoff (P1) -> scan (S1) -> anti-join state (J1) -> triage (verdicts) -> keep (P2)
-> priority cap (T1) -> extract (F10..U1) -> digest (U6/F17/F18 + F16/F22) ->
actions (S10), state delta (S8), run row (S9).  The cap reads category and order
only and extraction keeps one row for each message, so the cap comes first: at
most ``max_synthesis_items`` messages are parsed and summarised.

Nothing is collected except the one-row cutoff, which enters the scan as a
scalar subquery.  Model callables are optional; without them the native
fallbacks of the reference are used (chunk truncation, fallback digest).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.operators import digest as D
from sifter.operators import extract as X
from sifter.operators import state_ops as S
from sifter.operators import triage as TR
from sifter.session import stored
from sifter.sources import sinks
from sifter.sources.keyed_state import KeyedState
from sifter.sources.state import new_processed_rows, next_run_row


@dataclass
class RunOutputs:
    fetched: DataFrame          # S1 result
    results: DataFrame          # every triage result with its kept flag
    capped: DataFrame           # <= max_synthesis_items extracted items with priority
    digest: DataFrame           # one row: subject, digest_md, n_items
    processed_delta: DataFrame  # S8 rows to append
    run_row: DataFrame          # S9 row to append

    def actions(self) -> DataFrame:
        """S10, built when it is written: numbering the batches stores the action rows."""
        return sinks.inbox_actions(self.results)


def run_digest(messages: DataFrame, verdicts: DataFrame, pages: DataFrame, processed: DataFrame,
               runs: DataFrame, as_of_epoch: Column, cfg: DigestConfig,
               synthesizer=None, summarizer=None, run_id: int | None = None, state: KeyedState | None = None) -> RunOutputs:
    """Build every output of one run.

    ``run_id`` names the run when it may be a replay: what an earlier attempt of
    the same run left in the state (its processed ids, its run row) is not seen,
    so the replay takes the same messages again.  With a ``state`` the processed
    ids are looked up there (only in the buckets that may hold them) instead of
    being joined as a table.

    ``verdicts(id, category, relevance_score, topics, reason)`` is the triage
    output for the messages (from ``positional_verdicts`` over model responses,
    from ``rubric_label``, or a stored table).
    """
    if run_id is not None:
        processed = processed.where(F.col("run_id") != run_id)
        runs = runs.where(F.col("id") != run_id)
    cutoff = S.resolve_cutoff(runs, as_of_epoch, cfg)
    fetched = S.scan_incremental(messages, cutoff, cfg)
    fresh = S.anti_join_processed(fetched, processed) if state is None else state.unseen(fetched)
    v = verdicts.select("id", "category", "relevance_score", "topics", "reason")
    results = TR.split_kept_discarded(fresh.join(v, "id"), cfg)
    kept = results.where("kept")
    if cfg.cap_per_sender_in_run:
        kept = TR.top_n_per_sender(TR.with_sender_key(kept), cfg.max_per_sender)
    capped = D.capped_items(kept, pages, cfg, summarizer=summarizer)
    parts = D.digest_parts(capped)
    if synthesizer is None:
        body = parts.select("n_items", "sources_md", F.col("fallback_md").alias("md"))
    else:
        prompt = parts.select("n_items", "sources_md", "fallback_md",
                              D.synthesis_prompt(F.col("items_block")).alias("prompt"))
        written = stored(D.write_digest(prompt, synthesizer), "digest")     # one call, one text
        body = written.select("n_items", "sources_md", F.coalesce("model_md", "fallback_md").alias("md"))
    # no items: the empty digest and an empty sources section (append is a no-op)
    digest = body.select(D.digest_subject(as_of_epoch).alias("subject"),
                         D.append_sources(F.col("md"), F.col("sources_md")).alias("digest_md"), "n_items")
    delta = new_processed_rows(processed, fresh.select("id"), as_of_epoch)
    n_fresh = fresh.select(F.count(F.lit(1))).scalar()
    run_row = next_run_row(runs, as_of_epoch, n_fresh)
    return RunOutputs(fetched, results, capped, digest, delta, run_row)


def model_verdicts(messages: DataFrame, cfg: DigestConfig, model) -> DataFrame:
    """Triage through a model callable: batches of 20 -> prompts -> one call per batch.

    The scored batches are stored (in the shared checkpoint folder) right after
    the calls, so later actions and retries read the stored output instead of
    calling the model again.
    """
    batched = TR.assign_batches(TR.triage_input(messages))
    responses = stored(TR.score_batches(TR.batch_pack(batched, cfg), model), "responses")
    return TR.positional_verdicts(batched.select("id", "ord", "batch_id", "idx"), responses)


def write_run(out: RunOutputs, state_dir: str, run_id: int, as_of_epoch: int, digest_path: str | None,
              cfg: DigestConfig) -> bool:
    """Sink one run: digest, actions, processed ids and the run row, published together.

    All are written to folders of this attempt; one ledger entry then publishes
    them at once, so a run that dies before it leaves nothing that is seen, and
    its replay publishes one consistent run.  A run that is published already is
    not written again.  ``digest_path`` gets a copy of the published digest.
    True if this call published the run; a dry run writes nothing."""
    if cfg.dry_run:
        return False
    state, name = KeyedState(out.results.sparkSession, state_dir), f"run-{run_id:012d}"
    published = False
    if not state.is_published(name):
        attempt = uuid.uuid4().hex
        outputs = [("digest", state.stage_output(out.digest.coalesce(1), attempt, "digest"), run_id),
                   ("actions", state.stage_output(out.actions(), attempt, "actions"), run_id)]
        ids = out.results.select("id")
        segment, _ = state.stage_ids(ids, as_of_epoch, run_id)
        run = {"id": run_id, "ran_epoch": as_of_epoch, "messages_processed": ids.distinct().count()}
        published = state.publish(name, {"segment": segment, "run": run, "outputs": outputs})
    if digest_path:
        digest = state.output("digest").where(F.col("run_id") == run_id).drop("run_id")
        sinks.digest_sink(digest, f"{digest_path}/run_id={run_id}", dry_run=False)
    return published
