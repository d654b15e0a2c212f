"""Scheduled runs: bounded micro-batches, the cap of a run over its batches, listener metrics, kills and replays."""

import random

import pytest
from pyspark.sql import functions as F

from sifter.session import shared_folder
from sifter.sources.keyed_state import KeyedState
from sifter.streaming.incremental import EVENT_SCHEMA, IncrementalRunner


def events(spark, run, ids, seed=1):
    rng = random.Random(seed)
    rows = [(i, None, rng.randrange(4) if i % 3 else 0, "view", float(i * 7 % 11), "{}", run) for i in ids]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def runner(spark, **more):
    return IncrementalRunner(spark, shared_folder(spark, "runs-test"), **more)


def delivered(spark, max_files):
    r = runner(spark, max_files=max_files)
    for run, ids in ((0, range(60)), (1, [*range(50, 100), 5, 5])):
        r.land(events(spark, run, ids).coalesce(1), records_per_file=6)
        r.run_once()
    return r


def tables(r):
    return (sorted(tuple(x) for x in r.processed().select("event_id", "user_id", "value", "run").collect()),
            sorted(tuple(x) for x in r.top().select("run", "user_id", "event_id", "value", "sender_rank").collect()),
            sorted(tuple(x) for x in r.metrics().groupBy("run").agg(F.sum("n_delivered"), F.sum("n_new"), F.sum("n_duplicates")).collect()))


def test_same_tables_for_few_and_many_files_a_trigger(spark):
    one, all_at_once = delivered(spark, 4), delivered(spark, 100)
    assert len(one.observed) == 6 and len(all_at_once.observed) == 2        # batches: 3 + 3, 1 + 1
    assert tables(one) == tables(all_at_once)
    processed, top, metrics = tables(one)
    assert [p[0] for p in processed] == list(range(100)) and metrics == [(0, 60, 60, 0), (1, 52, 40, 12)]
    # the cap holds for the run, not for each of its batches
    best = {}
    for i, user, value, run in processed:
        best.setdefault((run, user), []).append((-value, i))
    expect = sorted((run, user, i, -v, n + 1) for (run, user), rows in best.items() for n, (v, i) in enumerate(sorted(rows)[:3]))
    assert top == expect


def test_listener_counts_equal_the_table(spark):
    r = delivered(spark, 4)
    counted = {x["batch_id"]: x["n"] for x in r.metrics().groupBy("batch_id").agg(F.sum("n_delivered").alias("n")).collect()}
    assert r.observed == counted and sum(counted.values()) == 112


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_merged_top", "stage_rows", "publish"])
def test_killed_batch_is_replayed(spark, monkeypatch, step):
    whole = delivered(spark, 100)
    r = runner(spark, max_files=100)
    r.land(events(spark, 0, range(60)).coalesce(1))
    owner = IncrementalRunner if step == "_merged_top" else KeyedState

    def dies(*args, **kw):
        raise Killed()

    with monkeypatch.context() as m:
        m.setattr(owner, step, dies)
        with pytest.raises(Exception):
            r.run_once()
    assert tables(r) == ([], [], [])                # nothing of the dead batch is seen
    r.run_once()
    r.land(events(spark, 1, [*range(50, 100), 5, 5]).coalesce(1))
    r.run_once()
    assert tables(r) == tables(whole)
    batch = spark.read.schema(EVENT_SCHEMA).parquet(r.landing)
    r.process_batch(batch, 0)                       # a replay of a published batch does nothing
    assert tables(r) == tables(whole)
