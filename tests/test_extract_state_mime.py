"""Token windows, extraction with a model, state idempotency, cutoff rules, MIME payloads, streaming replay."""

import base64
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.functions import text as T
from sifter.operators import extract as X
from sifter.operators import state_ops as S
from sifter.sources import mime as M
from sifter.sources import state as ST
from sifter.sources.keyed_state import KeyedState


def test_window_counts_and_cover(spark):
    cfg = DigestConfig(token_budget=200)
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 200, 201, 350, 351, 7000)]
    df = spark.createDataFrame(rows, "n int, t string").withColumn("tok", T.word_pieces("t"))
    w = df.select("n", "t", X.token_windows(F.col("tok"), cfg.token_budget, cfg.window_stride).alias("w")).collect()
    for r in w:
        starts = [x.start for x in r.w]
        assert starts == list(range(0, r.n, 150))                    # count = ceil(n / stride)
        assert all(len(x.chunk_text.split()) == min(200, r.n - x.start) for x in r.w)
        if r.n:
            assert r.w[0].chunk_text.startswith("w0") and r.w[-1].chunk_text.endswith(f"w{r.n - 1}")


def test_budget_one_rejected():
    with pytest.raises(ValueError):
        DigestConfig(token_budget=1)


def test_extract_with_summarizer(spark):
    cfg = DigestConfig(token_budget=10)
    kept = spark.createDataFrame(
        [("1", 1, "N <n@x>", "s", "snip", "", " ".join(["w"] * 25), "general_info", ["t"]),
         ("2", 2, "M <m@x>", "s2", "snip2", "", "short text", "general_info", None)],
        "id string, ord long, sender string, subject string, snippet string, body_html string, body_text string, "
        "category string, topics array<string>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")

    def summarizer(system, user):
        if "w w" not in user:
            raise RuntimeError
        return "S"

    items = X.extract_items(kept, pages, cfg, summarizer=summarizer).orderBy("ord").collect()
    assert items[0].summary_text == "S\n\nS\n\nS\n\nS"                # 25 tokens, stride 7 -> 4 windows
    assert items[1].summary_text == "short text" and items[1].source_name == "M"


def test_cutoff_rules(spark):
    runs = spark.createDataFrame([(1, 100, 1), (2, 300, 0), (3, 200, 5)], "id long, ran_epoch long, messages_processed long")
    empty = spark.createDataFrame([], runs.schema)
    asof = F.lit(1_000_000)
    assert S.resolve_cutoff(runs, asof, DigestConfig()).first().cutoff_epoch == 200          # greatest id, not time
    assert S.resolve_cutoff(empty, asof, DigestConfig()).first().cutoff_epoch == 1_000_000 - 7 * 86400
    assert S.resolve_cutoff(runs, asof, DigestConfig(lookback_days_override=2)).first().cutoff_epoch == \
        1_000_000 - 2 * 86400
    assert S.last_run(empty).first().last_ran_epoch is None


def test_append_processed_is_replay_safe(spark):
    d = tempfile.mkdtemp(prefix="sifter-state-")
    ids1 = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    ST.append_processed(spark, d, ids1, 10, run_id=1)
    ST.append_processed(spark, d, ids1, 11, run_id=1)                     # replay of run 1
    ids2 = spark.createDataFrame([("b",), ("c",)], "id string")
    ST.append_processed(spark, d, ids2, 20, run_id=2)
    got = sorted((r.message_id, r.processed_epoch) for r in ST.read_state(spark, d)[0].collect())
    assert got == [("a", 10), ("b", 10), ("c", 20)]        # first time wins, also over a replay; no duplicates


def _b64(s: bytes) -> str:
    return base64.urlsafe_b64encode(s).decode().rstrip("=")


def test_mime_payloads(spark):
    nested = {"snippet": "sn", "payload": {
        "mimeType": "multipart/mixed",
        "headers": [{"name": "Subject", "value": "first"}, {"name": "SUBJECT", "value": "second"},
                    {"name": "From", "value": "A <a@b>"}],
        "parts": [{"mimeType": "multipart/alternative", "parts": [
            {"mimeType": "text/plain", "body": {"data": _b64("héllo".encode())}},
            {"mimeType": "text/html", "body": {"data": _b64(b"<p>x</p>")}}]},
            {"mimeType": "text/plain", "body": {"data": _b64(b"ab\xff\xe2\x82c")}},
            {"mimeType": "text/plain", "body": {"data": ""}},
            {"mimeType": "image/png", "body": {"data": _b64(b"png")}}]}}
    missing = {"payload": {"mimeType": "text/plain", "body": {"data": _b64(b"x")}}}
    raw = spark.createDataFrame([("1", json.dumps(nested)), ("2", json.dumps(missing))], "id string, payload_json string")
    h = {r.id: r for r in M.parse_headers(raw).collect()}
    assert set(h) == {"1"}
    assert (h["1"].subject, h["1"].sender, h["1"].date, h["1"].snippet) == ("second", "A <a@b>", "", "sn")
    body = {r.id: r for r in M.flatten_mime(raw).collect()}
    assert body["1"].body_text == "héllo\nab��c" and body["1"].body_html == "<p>x</p>"
    assert body["2"].body_text == "x"


def test_mime_tree_of_any_depth(spark):
    def nested(depth):
        node = {"mimeType": "text/plain", "body": {"data": _b64(f"at {depth}".encode())}}
        for _ in range(depth):
            node = {"mimeType": "multipart/mixed", "parts": [
                {"mimeType": "text/plain", "body": {"data": _b64(b"side")}}, node]}
        return json.dumps({"payload": node})

    depths = (0, 3, 4, 5, 8, 9, 12, 30, 300)
    raw = spark.createDataFrame([(str(d), nested(d)) for d in depths], "id string, payload_json string")
    body = {r.id: r for r in M.flatten_mime(raw).collect()}
    for d in depths:
        assert body[str(d)].body_text == "\n".join(["side"] * d + [f"at {d}"]) and body[str(d)].n_parts == 2 * d + 1
    parts = M.decoded_parts(raw).where("id = '30'").collect()
    assert len(parts) == 31 and max(r.path.count(".") for r in parts) == 29
    # one pass over the source: nothing is joined, exploded or stored on the way
    plan = M.flatten_mime(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and not any(x in plan for x in ("Join", "Generate", "Exchange", "Union"))


def test_mime_key_written_with_escapes(spark):
    """The depth is bounded by brackets, not by how the keys are written."""
    leaf = '{"mimeType":"text/plain","body":{"data":"%s"}}' % _b64(b"in")
    text = leaf
    for _ in range(9):
        text = '{"p\\u0061rts":[' + text + "]}"
    raw = spark.createDataFrame([("1", '{"payload":' + text + "}"), ("2", "no json"), ("3", None)], "id string, payload_json string")
    assert {r.id: (r.body_text, r.n_parts) for r in M.flatten_mime(raw).collect()} == {"1": ("in", 10), "2": ("", 1), "3": ("", 1)}


def test_full_run_with_model_and_state(spark):
    from sifter.functions.models import rubric_model
    from sifter.plans.digest_run import model_verdicts, run_digest, write_run
    from sifter.sources.fixtures import load
    fx = load(spark, "/root/testdata/sf0.001")
    cfg = DigestConfig()
    msgs = fx.messages()
    verdicts = model_verdicts(msgs, cfg, rubric_model(cfg))
    state = tempfile.mkdtemp(prefix="sifter-run-")
    processed, runs = ST.read_state(spark, state)
    as_of = 1704067200 + 86400
    out = run_digest(msgs, verdicts, fx.pages(), processed, runs, F.lit(as_of), cfg)
    d = out.digest.first()
    assert d.subject.startswith("Newsletter Briefing — Morning, January 02, 2024")
    assert d.n_items == min(25, out.results.where("kept").count())
    write_run(out, state, 1, as_of, f"{state}/digest", cfg)
    processed, runs = ST.read_state(spark, state)
    assert processed.count() == out.results.count() and runs.count() == 1
    # a second run sees nothing new: every fetched id is already processed
    out2 = run_digest(msgs, verdicts, fx.pages(), processed, runs, F.lit(as_of + 60), cfg)
    assert out2.results.count() == 0 and out2.digest.first().n_items == 0


def test_replay_of_a_broken_run(spark):
    """A run that dies before its run row is written gives the same outputs when it is run again."""
    from sifter.plans.digest_run import run_digest, write_run
    from sifter.sources.fixtures import load
    fx, cfg, as_of = load(spark, "/root/testdata/sf0.001"), DigestConfig(), 1704067200 + 86400
    state = tempfile.mkdtemp(prefix="sifter-replay-")

    def attempt(at):
        processed, runs = ST.read_state(spark, state)
        return run_digest(fx.messages(), fx.verdicts(), fx.pages(), processed, runs, F.lit(at), cfg, run_id=1)

    broken = attempt(as_of)
    digest = broken.digest.first()
    sent = broken.actions().count()
    KeyedState(spark, state).stage_output(broken.actions(), "lost", "actions")
    ST.append_processed(spark, state, broken.results.select("id"), as_of, 1)
    # ... and here it died
    again = attempt(as_of)
    write_run(again, state, 1, as_of, f"{state}/digest", cfg)
    assert again.digest.first() == digest and digest.n_items > 0
    assert spark.read.parquet(f"{state}/digest/run_id=1").first().digest_md == digest.digest_md
    assert KeyedState(spark, state).output("actions").count() == sent > 0
    processed, runs = ST.read_state(spark, state)
    assert {r.processed_epoch for r in processed.collect()} == {as_of}
    assert [(r.id, r.messages_processed) for r in runs.collect()] == [(1, processed.count())]


def test_streaming_dedupe_variants(spark):
    """R2: exact dedupe across availableNow runs, and the bounded-state watermark variant."""
    from sifter.streaming.incremental import EVENT_SCHEMA, IncrementalRunner, dedupe_within_watermark
    root = tempfile.mkdtemp(prefix="sifter-stream-")
    base = spark.createDataFrame(
        [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "view", float(i), "{}", 0) for i in range(10)],
        EVENT_SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    runner = IncrementalRunner(spark, root)
    runner.land(base)
    runner.run_once()
    runner.land(base.where("event_id >= 8").withColumn("run", F.lit(1)))        # re-delivery
    runner.land(base.limit(0).unionByName(base.where("event_id = 9")).withColumn("run", F.lit(1)))
    runner.run_once()
    got = sorted((r.event_id, r.run) for r in runner.processed().collect())
    assert got == [(i, 0) for i in range(10)]
    m = {r.run: (r.n_delivered, r.n_new, r.n_duplicates) for r in
         runner.metrics().groupBy("run").agg(F.sum("n_delivered").alias("n_delivered"), F.sum("n_new").alias("n_new"),
                                             F.sum("n_duplicates").alias("n_duplicates")).collect()}
    assert m == {0: (10, 10, 0), 1: (3, 0, 3)}
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(runner.landing)
    q = (dedupe_within_watermark(stream).writeStream.format("memory").queryName("wm_dedupe")
         .option("checkpointLocation", f"{root}/wm-ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert sorted(r.event_id for r in spark.sql("SELECT event_id FROM wm_dedupe").collect()) == list(range(10))


def test_incremental_scan_prunes_day_partitions(spark):
    from sifter.sources.fixtures import load
    from sifter.sources.messages import read_messages, write_messages
    fx = load(spark, "/root/testdata/sf0.001")
    path = tempfile.mkdtemp(prefix="sifter-msgs-") + "/messages"
    msgs = fx.messages().withColumn("received_epoch", F.col("received_epoch") + F.col("ord") * 3600)
    write_messages(msgs, path)
    stored = read_messages(spark, path)
    cutoff = 1704067200 + 150 * 3600 * 1 + 150 * 60
    out = S.scan_incremental(stored, cutoff, DigestConfig())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_date" in plan and "received_date" in plan.split("PartitionFilters")[1][:200]
    assert "GreaterThan(received_epoch," in plan                     # pushed into the scan
    expect = msgs.where(F.col("received_epoch") > cutoff).where(
        F.array_contains("label_ids", "UNREAD") & F.array_contains("label_ids", "IMPORTANT")).count()
    assert out.count() == expect > 0


def test_malformed_count_observed(spark):
    from pyspark.sql import Observation
    good = {"payload": {"headers": [{"name": "Subject", "value": "s"}]}}
    raw = spark.createDataFrame([("1", json.dumps(good)), ("2", '{"payload": {"headers": "x"}}'), ("3", "{}"),
                                 ("4", '{"payload": {"headers": [{"name": "a"}]}}')], "id string, payload_json string")
    obs = Observation("ingest")
    rows = M.parse_headers(raw, obs).collect()
    assert [r.id for r in rows] == ["1"]
    assert obs.get == {"malformed": 3, "total": 4}


def test_listing_text_in_order(spark):
    from sifter.sources import sinks
    rows = [(str(i), 100 - i, f"subj {i}", f"s{i}@x", 1704067200 + i, "x" * 130) for i in range(30)]
    fetched = spark.createDataFrame(rows, "id string, ord long, subject string, sender string, received_epoch long, "
                                          "snippet string").repartition(4)
    listing = sinks.fetched_listing(fetched)
    path = tempfile.mkdtemp(prefix="sifter-listing-") + "/listing"
    sinks.write_lines(listing, path, ["n"])
    import glob
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))
    head = "Fetched 30 emails (query: category:updates is:unread is:important)\n\n"
    assert text.startswith(head + "1. subj 29\n   From: s29@x\n   Date: Mon, 01 Jan 2024 00:00:29 +0000\n   Snippet: " + "x" * 120)
    assert text.count(". subj ") == 30 and text.index("2. subj 28") < text.index("30. subj 0")


def test_run_digest_with_synthesizer(spark):
    from sifter.plans.digest_run import run_digest
    from sifter.sources.fixtures import load
    fx = load(spark, "/root/testdata/sf0.001")
    cfg = DigestConfig()
    processed, runs = ST.read_state(spark, tempfile.mkdtemp(prefix="sifter-syn-"))

    def synth(system, prompt):
        assert prompt.startswith("Here are today's extracted newsletter items.") and "--- Item ---\nSource: " in prompt
        return "## Topic\nBody"

    out = run_digest(fx.messages(), fx.verdicts(), fx.pages(), processed, runs, F.lit(1704067200 + 86400), cfg,
                     synthesizer=synth)
    d = out.digest.first()
    assert d.digest_md.startswith("## Topic\nBody\n\n## Sources\n- [")
    assert 0 < d.n_items <= cfg.max_synthesis_items
    assert d.digest_md.count("](https://mail.google.com/mail/u/0/#inbox/") == d.n_items   # one source per item
