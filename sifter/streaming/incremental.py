"""Scheduled incremental runs as Structured Streaming.

Each scheduled run lands new files in a folder and then starts the same
streaming query with ``trigger(availableNow=True)``: the file source's
checkpointed offsets make every run process exactly the files that arrived
since the previous run (no time cutoff, so nothing that lands while a run is
in progress is skipped).  A backlog is taken in micro-batches of at most
``max_files`` files.  ``foreachBatch`` then, per micro-batch:

* dedupes exactly against the keyed state of processed ids (R2) — unbounded
  horizon, like the reference's processed-message table, but only the buckets
  that may hold one of the batch's ids are read;
* caps each sender at ``max_per_sender`` per run (R3): the batch's rows are
  merged with the rows that earlier batches of the same run kept for the same
  senders, so the cap holds however many batches a run has;
* appends per-run metrics (R4); what was delivered is also observed in the
  stream itself and told by a listener.

A batch is evaluated once, into a table of what arrived; accepted rows are written
once and read back from the written partition; nothing is persisted in memory.  Every write goes to a ``batch_id`` partition
with dynamic partition overwrite, and a batch counts as done when its ledger
entry is published together with its ids: a batch that dies is not seen, its
replay replaces what it left, and a replay of a published batch does nothing.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.utils import AnalysisException

from sifter.session import ensure_checkpoint_dir
from sifter.sources.keyed_state import KeyedState

EVENT_SCHEMA = ("event_id long, ts timestamp, user_id long, event_type string, value double, props string, "
                "run int")
ARRIVED_SCHEMA = "event_id long, run int, n long, user_id long, value double, batch_id long"
PROCESSED_SCHEMA = "event_id long, user_id long, value double, run int, batch_id long"
TOP_SCHEMA = "run int, user_id long, event_id long, value double, sender_rank int, batch_id long"
METRICS_SCHEMA = "run int, n_delivered long, n_new long, n_duplicates long, batch_id long"


def landing_slices(events: DataFrame, n_runs: int = 3) -> list[DataFrame]:
    """The events as ``n_runs`` deliveries by event id, each overlapping its
    neighbours by 1% of the table (those ids are delivered twice)."""
    n = events.select(F.count(F.lit(1))).scalar()
    q = F.floor(n / n_runs)
    d = F.floor(n / 100)
    e = F.col("event_id")
    out = []
    for k in range(n_runs):
        lo = e >= q * k - d if k > 0 else F.lit(True)
        hi = e < q * (k + 1) + d if k < n_runs - 1 else F.lit(True)
        out.append(events.where(lo & hi).withColumn("run", F.lit(k)))
    return out


def dedupe_within_watermark(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """R2, bounded-state variant: duplicates arriving within ``delay`` of each other are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


class DeliveryListener(StreamingQueryListener):
    """Collects what the stream observed: rows delivered in each micro-batch (one number a batch)."""

    def __init__(self):
        self.delivered: dict[int, int] = {}
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("delivery")
        if row is not None and row["n_delivered"]:
            self.delivered[event.progress.batchId] = row["n_delivered"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


@dataclass
class IncrementalRunner:
    spark: SparkSession
    root: str
    max_per_sender: int = 3
    max_files: int | None = None        # files of one micro-batch; None: all that have arrived
    observed: dict[int, int] = field(default_factory=dict)      # micro-batch -> rows delivered, from the listener

    @property
    def landing(self) -> str:
        return f"{self.root}/landing"

    @property
    def state(self) -> KeyedState:
        return KeyedState(self.spark, f"{self.root}/state")

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.table(name))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _published(self, name: str, schema: str) -> DataFrame:
        done = [int(x.rsplit("-", 1)[1]) for x in self.state.published("batch-")]
        return self._read(name, schema).where(F.col("batch_id").isin(done))

    def _write(self, df: DataFrame, name: str) -> None:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(self.table(name)))

    def land(self, delivery: DataFrame, records_per_file: int = 0) -> None:
        """A delivery arrives: append its files to the landing folder."""
        delivery.write.mode("append").option("maxRecordsPerFile", records_per_file).parquet(self.landing)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """R2 + R3 + R4 for one micro-batch (idempotent per batch_id)."""
        state, entry, number = self.state, f"batch-{batch_id:012d}", F.lit(batch_id).cast("long").alias("batch_id")
        if state.is_published(entry):
            return
        # the only evaluation of the batch: one row for each id and run, with how often it was delivered
        self._write(batch.groupBy("event_id", "run").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("user_id", "value")).alias("first")).select("event_id", "run", "n", "first.*", number), "arrived")
        arrived = self._read("arrived", ARRIVED_SCHEMA).where(F.col("batch_id") == batch_id)
        first = Window.partitionBy("event_id").orderBy("run")
        unique = (arrived.withColumn("_c", F.row_number().over(first)).where(F.col("_c") == 1)
                  .select("event_id", "user_id", "value", "run"))
        self._write(state.unseen(unique, "event_id").select("*", number), "processed")
        new = self._read("processed", PROCESSED_SCHEMA).where(F.col("batch_id") == batch_id)
        self._write(self._merged_top(new, batch_id).select("run", "user_id", "event_id", "value", "sender_rank", number), "top")
        delivered = arrived.groupBy("run").agg(F.sum("n").alias("n_delivered"))
        fresh = new.groupBy("run").agg(F.count(F.lit(1)).alias("n_new"))
        self._write(delivered.join(fresh, "run", "left").select(
            "run", "n_delivered", F.coalesce("n_new", F.lit(0)).alias("n_new"),
            (F.col("n_delivered") - F.coalesce("n_new", F.lit(0))).alias("n_duplicates"), number), "metrics")
        segment, _ = state.stage_rows(new.select(F.col("event_id").cast("string").alias("message_id"),
                                                 F.lit(batch_id).alias("processed_epoch"), F.col("run").alias("run_id")))
        state.publish(entry, {"segment": segment})

    def _merged_top(self, new: DataFrame, batch_id: int) -> DataFrame:
        """The best rows of each (run, sender) of this batch, among its rows and those kept by earlier batches."""
        touched = new.select("run", "user_id").distinct()
        kept = self._latest_top(self._read("top", TOP_SCHEMA).where(F.col("batch_id") < batch_id).join(touched, ["run", "user_id"], "left_semi"))
        cols = ["run", "user_id", "event_id", "value"]
        w = Window.partitionBy("run", "user_id").orderBy(F.col("value").desc(), F.col("event_id"))
        return (new.select(*cols).unionByName(kept.select(*cols)).withColumn("sender_rank", F.row_number().over(w))
                .where(F.col("sender_rank") <= self.max_per_sender))

    @staticmethod
    def _latest_top(rows: DataFrame) -> DataFrame:
        """A later batch writes all rows of the senders it touches again: the last ones of each (run, sender) hold."""
        last = F.max("batch_id").over(Window.partitionBy("run", "user_id"))
        return rows.withColumn("_last", last).where(F.col("batch_id") == F.col("_last")).drop("_last")

    def run_once(self) -> None:
        """One scheduled run: process everything that landed since the last run, however long it takes."""
        reader = self.spark.readStream.schema(EVENT_SCHEMA)
        if self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        stream = reader.parquet(self.landing).observe("delivery", F.count(F.lit(1)).alias("n_delivered"))
        listener = DeliveryListener()
        self.spark.streams.addListener(listener)
        try:
            q = (stream.writeStream.foreachBatch(self.process_batch)
                 .option("checkpointLocation", f"{self.root}/checkpoint")
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            waited = time.monotonic()               # the listener is told a little later
            while not listener.ended and time.monotonic() - waited < 30:
                time.sleep(0.05)
        finally:
            self.spark.streams.removeListener(listener)
        self.observed.update(listener.delivered)

    def processed(self) -> DataFrame:
        return self._published("processed", PROCESSED_SCHEMA)

    def top(self) -> DataFrame:
        return self._latest_top(self._published("top", TOP_SCHEMA))

    def metrics(self) -> DataFrame:
        return self._published("metrics", METRICS_SCHEMA)


def run_schedule(spark: SparkSession, events: DataFrame, n_runs: int = 3, files: int = 4, max_files: int = 2) -> IncrementalRunner:
    """Land the deliveries one by one, each as about ``files`` files, with one availableNow run after each that takes
    ``max_files`` files a micro-batch.  The folders live under the session's (shared) checkpoint folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    runner = IncrementalRunner(spark, root, max_files=max_files)
    rows = max(1, events.count() // (n_runs * files))
    for delivery in landing_slices(events, n_runs):
        runner.land(delivery, rows)
        runner.run_once()
    return runner
