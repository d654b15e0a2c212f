"""Registered incremental / streaming queries (R1-R4) over the events table.

Mapping (SURVEY §7.3 step 8): message id = ``event_id``, sender = ``user_id``,
score = ``value``.  The events arrive as three overlapping deliveries of several
files; each delivery is followed by one ``availableNow`` run of the same streaming
query, which takes two files a micro-batch.  Every query runs its own schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.plans import oracle as O
from sifter.plans.catalog import CFG, register
from sifter.sources.fixtures import Fixtures
from sifter.streaming.incremental import run_schedule

SQL_SLICES = [
    ("ev_n", "SELECT count(*) AS n, count(*) // 3 AS q, count(*) // 100 AS d FROM events"),
    ("deliv", """SELECT e.event_id, e.user_id, e.value, k.run
                 FROM events e, ev_n, (VALUES (0), (1), (2)) k(run)
                 WHERE (k.run = 0 OR e.event_id >= ev_n.q * k.run - ev_n.d)
                   AND (k.run = 2 OR e.event_id < ev_n.q * (k.run + 1) + ev_n.d)"""),
    ("first_run", """SELECT event_id, any_value(user_id) AS user_id, any_value(value) AS value, min(run) AS run
                     FROM deliv GROUP BY event_id"""),
]


def schedule(fx: Fixtures):
    return run_schedule(fx.spark, fx.table("events"))


@register("incremental_run", O.compose(SQL_SLICES, "SELECT event_id, run FROM first_run"))
def q_incremental_run(fx: Fixtures) -> DataFrame:
    """After three scheduled runs, the run that processed each event."""
    return schedule(fx).processed().select("event_id", "run")


@register("stream_dedupe", O.compose([], "SELECT event_id FROM events"))
def q_stream_dedupe(fx: Fixtures) -> DataFrame:
    """R2: every event id processed exactly once although 2% were delivered twice."""
    return schedule(fx).processed().select("event_id")


@register("stream_top_n", O.compose(SQL_SLICES, f"""
SELECT run, user_id, event_id, value, sender_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY run, user_id ORDER BY value DESC, event_id) AS INTEGER) AS sender_rank
  FROM first_run) WHERE sender_rank <= {CFG.max_per_sender}"""))
def q_stream_top_n(fx: Fixtures) -> DataFrame:
    """Per run, at most 3 new events per sender, highest value first."""
    return schedule(fx).top().select("run", "user_id", "event_id", "value", "sender_rank")


@register("run_metrics", O.compose(SQL_SLICES, """
SELECT d.run, d.n_delivered, coalesce(f.n_new, 0) AS n_new, d.n_delivered - coalesce(f.n_new, 0) AS n_duplicates
FROM (SELECT run, count(*) AS n_delivered FROM deliv GROUP BY run) d
LEFT JOIN (SELECT run, count(*) AS n_new FROM first_run GROUP BY run) f ON f.run = d.run"""))
def q_run_metrics(fx: Fixtures) -> DataFrame:
    """Per run, delivered / new / duplicate counts."""
    m = schedule(fx).metrics()
    return m.groupBy("run").agg(F.sum("n_delivered").alias("n_delivered"), F.sum("n_new").alias("n_new"),
                                F.sum("n_duplicates").alias("n_duplicates"))
