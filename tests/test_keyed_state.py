"""Keyed state: lookups that read few buckets, one commit a run, kills and replays, compaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sifter.config import DigestConfig
from sifter.plans.digest_run import run_digest, write_run
from sifter.session import shared_folder
from sifter.sources.fixtures import load
from sifter.sources.keyed_state import KeyedState, bloom_size


def ids_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def new_state(spark, **more):
    return KeyedState(spark, shared_folder(spark, "keyed-test"), **more)


def filled(spark, runs=3, n=400, buckets=16):
    state = new_state(spark, buckets=buckets)
    for run in range(runs):
        segment, _ = state.stage_ids(ids_of(spark, [f"r{run}-{i}" for i in range(n)]), 100 + run, run)
        assert state.publish(f"ids-{run:012d}", {"segment": segment})
    return state


def test_lookup_equals_membership(spark):
    state, rng = filled(spark), random.Random(2)
    asked = [f"r{rng.randrange(6)}-{rng.randrange(800)}" for _ in range(500)] + ["r0-1", "r0-1", None]
    there = {f"r{run}-{i}": 100 + run for run in range(3) for i in range(400)}
    got = {r.id: r.processed_epoch for r in state.known(ids_of(spark, asked)).collect()}
    assert got == {a: there[a] for a in asked if a in there}
    left = sorted(r.id or "" for r in state.unseen(ids_of(spark, asked)).collect())
    assert left == sorted(a or "" for a in asked if a not in there)
    assert state.processed().count() == 1200
    assert new_state(spark).known(ids_of(spark, ["a"])).count() == 0


def test_only_touched_buckets_are_read(spark, monkeypatch):
    state, read = filled(spark), []
    inner = KeyedState._in_buckets
    monkeypatch.setattr(KeyedState, "_in_buckets", lambda self, segments, touched: (read.append(set(touched)), inner(self, segments, touched))[1])
    own = spark.range(1).select(state._bucket(F.lit("r1-7"))).first()[0]
    known = state.known(ids_of(spark, ["r1-7", "never seen"]))
    assert own in read[-1] and len(read[-1]) <= 2 and [r.id for r in known.collect()] == ["r1-7"]
    # that choice reaches the scan: other buckets' files are not listed for reading
    plan = inner(state, state._segments(), [own])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {own}\)", plan), plan
    # sixty unknown ids fall into nearly all buckets; the filters refuse nearly all of them
    none = ids_of(spark, [f"new-{i}" for i in range(60)])
    assert len({r[0] for r in none.select(state._bucket(F.col("id"))).collect()}) >= 14
    assert state.unseen(none).count() == 60 and len(read[-1]) <= 4


def test_bloom_sizes():
    assert bloom_size(0) == bloom_size(102) == 1024 and bloom_size(103) == 2048 and bloom_size(10**6) == 1 << 24


def test_compaction_and_vacuum(spark):
    state = filled(spark)
    state.publish("run-000000000007", {"run": {"id": 7, "ran_epoch": 5, "messages_processed": 2}})
    before = sorted(state.processed().collect())
    assert state.vacuum(3600) == []
    state.compact()
    assert len(state.entries()) == 1 and sorted(state.processed().collect()) == before
    assert [tuple(r) for r in state.runs().collect()] == [(7, 5, 2)]
    assert {r.id for r in state.known(ids_of(spark, ["r2-5", "x"])).collect()} == {"r2-5"}
    assert state.is_published("ids-000000000001")           # a compacted run is still known as published
    gone = state.vacuum(-60)
    assert len([g for g in gone if g.startswith("ids/")]) == 3 and sorted(state.processed().collect()) == before
    assert state.compact() is None
    segment, n = state.stage_ids(ids_of(spark, ["r2-5", "later"]), 9, 9)
    assert n == 1 and state.processed().count() == 1200      # not published yet
    state.publish("ids-9", {"segment": segment})
    assert state.processed().count() == 1201
    assert not state.publish("ids-9", {"segment": "other"})  # the first one stays


class Killed(Exception):
    pass


def test_a_kill_at_each_step_then_a_replay(spark, monkeypatch):
    """Whatever step a run dies at, nothing of it is seen, and the replay gives the one whole run."""
    fx, cfg, as_of = load(spark, "/root/testdata/sf0.001"), DigestConfig(), 1704067200 + 86400

    def run(state, at):
        return run_digest(fx.messages(), fx.verdicts(), fx.pages(), state.processed(), state.runs(), F.lit(at), cfg, run_id=1, state=state)

    whole = new_state(spark)
    assert write_run(run(whole, as_of), whole.folder, 1, as_of, None, cfg)
    digest = whole.output("digest").first().digest_md
    actions = sorted(map(str, whole.output("actions").collect()))
    ids = sorted(r.message_id for r in whole.processed().collect())
    assert digest and actions and ids

    for step in range(4):                                   # digest, actions, ids, publication
        state, done = new_state(spark), []

        def dying(f):
            def g(*args, **kw):
                if len(done) == step:
                    raise Killed()
                done.append(f.__name__)
                return f(*args, **kw)
            return g

        with monkeypatch.context() as m:
            for name in ("stage_output", "stage_ids", "publish"):
                m.setattr(KeyedState, name, dying(getattr(KeyedState, name)))
            with pytest.raises(Killed):
                write_run(run(state, as_of), state.folder, 1, as_of, None, cfg)
        assert state.entries() == {} and state.processed().count() == state.runs().count() == 0 and state.output("digest") is None
        assert write_run(run(state, as_of), state.folder, 1, as_of, None, cfg)
        assert not write_run(run(state, as_of), state.folder, 1, as_of + 5, None, cfg)      # and once more: nothing changes
        assert state.output("digest").first().digest_md == digest
        assert sorted(map(str, state.output("actions").collect())) == actions
        assert sorted((r.message_id, r.processed_epoch) for r in state.processed().collect()) == [(i, as_of) for i in ids]
        assert [tuple(r) for r in state.runs().collect()] == [(1, as_of, len(ids))]
