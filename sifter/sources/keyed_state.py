"""Processed ids and the run log as keyed segments under one ledger.

Layout of a state folder::

    ids/segment=S/bucket=B/   message_id, processed_epoch, run_id; the bucket is a hash of the id
    blooms/segment=S/         one Bloom filter for each bucket of the segment
    runs/segment=S/           run rows that a compaction folded in
    outputs/<attempt>/<name>/ what a run wrote (digest, actions)
    ledger/<entry>.json       what is published

Everything a run writes lies in folders of its own attempt and is seen by nobody
until its ledger entry, one small file, is renamed into place: that is the run's
only commit.  An attempt that dies leaves nothing visible, a replay writes a new
attempt, and a run that is published already is not published again.

A lookup first asks the Bloom filters, which take about a byte for each id, and
reads only those buckets of the history that may hold one of the ids asked for
(a partition filter).  ``compact`` rewrites all segments as one and publishes it
with an entry that replaces theirs; ``vacuum`` deletes what is no longer
published.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.session import stored

PROCESSED_SCHEMA = "message_id string, processed_epoch long, run_id long"
RUNS_SCHEMA = "id long, ran_epoch long, messages_processed long"
#: Bits and probes of a Bloom filter for each id: one unknown id in a hundred is looked up in vain.
BITS, PROBES = 10, 7


def bloom_size(n: int) -> int:
    """Bits of a filter for n ids: a power of two (small filters a kilobit: their probes are less independent)."""
    return 1 << max(10, (BITS * n - 1).bit_length())


def probe_bits(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """(probe, id) -> bit."""
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (h1.astype(np.uint64) + steps * (h2.astype(np.uint64) | np.uint64(1))) & np.uint64(size - 1)


def _build_blooms(batches, sizes: dict[int, int]):
    """Rows (bucket, h1, h2) sorted by bucket -> (bucket, bits), one filter at a time."""
    now, bits = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                          ["bucket", "bits"])

    for b in batches:
        bucket, h1, h2 = (b.column(k).to_numpy() for k in range(3))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [bucket.size]])
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            if now != bucket[a]:
                if now is not None:
                    yield done()
                now, bits = int(bucket[a]), np.zeros(sizes[int(bucket[a])], bool)
            bits[probe_bits(h1[a:z], h2[a:z], bits.size)] = True
    if now is not None:
        yield done()


def _admitted(batches):
    """Rows sorted by (bucket, filters first): ids that a filter of their bucket admits -> (id, bucket)."""
    now, filters = None, []
    for b in batches:
        bucket, raw, ids, h1, h2 = b.column(0).to_numpy(), b.column(1), b.column(2), b.column(3), b.column(4)
        is_filter = raw.is_valid().to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(is_filter.astype(np.int8)) != 0)) + 1, [bucket.size]])
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            if now != bucket[a]:
                now, filters = int(bucket[a]), []
            if is_filter[a]:
                filters += [np.frombuffer(x, np.uint8) for x in raw.slice(a, z - a).to_pylist()]
                continue
            p1, p2 = (c.slice(a, z - a).to_numpy(zero_copy_only=False) for c in (h1, h2))
            hit = np.zeros(z - a, bool)
            for bits in filters:
                at = probe_bits(p1, p2, bits.size * 8)
                hit |= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(0)
            if hit.any():
                found = ids.slice(a, z - a).filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(found), now), pa.int32())], ["id", "bucket"])


@dataclass
class KeyedState:
    spark: SparkSession
    folder: str
    buckets: int = 64       # fixed for a folder; about a million ids a bucket is a good size

    # ---------------------------------------------------------------- ledger

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[str, dict]:
        """Published entries that no compaction has replaced (as many as runs since the last one)."""
        p, fs = self._fs(f"{self.folder}/ledger")
        if not fs.exists(p):
            return {}
        found = {}
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith(("_", ".")):
                stream = fs.open(status.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found[name[:-5]] = json.loads(text)
        gone = {x for e in found.values() for x in e.get("replaces", [])}
        return {k: e for k, e in sorted(found.items()) if k not in gone}

    def published(self, prefix: str) -> list[str]:
        """Names of all entries ever published that start so, replaced ones too."""
        p, fs = self._fs(f"{self.folder}/ledger")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n[:-5] for n in names if n.startswith(prefix) and n.endswith(".json"))

    def is_published(self, name: str) -> bool:
        p, fs = self._fs(f"{self.folder}/ledger/{name}.json")
        return fs.exists(p)

    def publish(self, name: str, entry: dict) -> bool:
        """The commit: the entry appears whole or not at all; False if one of that name is there already."""
        target, fs = self._fs(f"{self.folder}/ledger/{name}.json")
        if fs.exists(target):
            return False
        draft, _ = self._fs(f"{self.folder}/ledger/_{name}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return bool(fs.rename(draft, target))

    def _segments(self) -> list[str]:
        return [e["segment"] for e in self.entries().values() if e.get("segment")]

    # ---------------------------------------------------------------- tables

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _ids(self, segments: list[str]) -> DataFrame:
        schema = f"{PROCESSED_SCHEMA}, segment string, bucket int"
        if not segments:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/ids/segment={s}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/ids").parquet(*paths)

    def processed(self) -> DataFrame:
        """Every published id, once."""
        return self._ids(self._segments()).select("message_id", "processed_epoch", "run_id")

    def runs(self) -> DataFrame:
        """The run log: folded rows and those of the entries since."""
        entries = self.entries().values()
        rows = [(e["run"]["id"], e["run"]["ran_epoch"], e["run"]["messages_processed"]) for e in entries if e.get("run")]
        out = self.spark.createDataFrame(rows, RUNS_SCHEMA)
        folded = [f"{self.folder}/runs/segment={e['runs']}" for e in entries if e.get("runs")]
        return out.unionByName(self.spark.read.schema(RUNS_SCHEMA).parquet(*folded)) if folded else out

    def output(self, name: str) -> DataFrame | None:
        """What the published runs wrote under this name, with their run_id."""
        out = None
        for e in self.entries().values():
            for kind, path, run_id in e.get("outputs", []):
                if kind == name:
                    df = self.spark.read.parquet(path).withColumn("run_id", F.lit(run_id).cast("long"))
                    out = df if out is None else out.unionByName(df)
        return out

    # ---------------------------------------------------------------- lookup

    def known(self, ids: DataFrame) -> DataFrame:
        """(id, processed_epoch) of those ids (column ``id``) that are in the state; reads the buckets that may hold them."""
        segments = self._segments()
        if not segments:
            return self.spark.createDataFrame([], "id string, processed_epoch long")
        key = F.col("id").cast("string")
        asked = ids.where("id IS NOT NULL").select(key.alias("id")).dropDuplicates().select(
            self._bucket(F.col("id")).alias("bucket"), F.lit(None).cast("binary").alias("bits"), "id",
            F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
        none = lambda t: F.lit(None).cast(t)
        filters = self.spark.read.schema("bucket int, bits binary").parquet(
            *[f"{self.folder}/blooms/segment={s}" for s in segments]).select(
            "bucket", "bits", none("string").alias("id"), none("long").alias("h1"), none("long").alias("h2"))
        maybe = stored(filters.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
                       .mapInArrow(_admitted, "id string, bucket int"), "state-maybe")
        touched = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())      # at most ``buckets`` numbers
        return self._in_buckets(segments, touched).join(maybe, ["id", "bucket"]).select("id", "processed_epoch")

    def _in_buckets(self, segments: list[str], touched: list[int]) -> DataFrame:
        return self._ids(segments).where(F.col("bucket").isin(touched)).select(
            F.col("message_id").alias("id"), "bucket", "processed_epoch")

    def unseen(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """The rows whose key is not in the state (a null key never is)."""
        hits = self.known(rows.select(F.col(key).alias("id"))).select(F.col("id").alias("_known"))
        return rows.join(hits, F.col(key).cast("string") == F.col("_known"), "left_anti")

    # ---------------------------------------------------------------- writing

    def stage_rows(self, rows: DataFrame) -> tuple[str, int]:
        """Rows (message_id, processed_epoch, run_id) as a new, still unpublished segment with its filters."""
        segment = uuid.uuid4().hex
        path = f"{self.folder}/ids/segment={segment}"
        placed = rows.select("message_id", F.col("processed_epoch").cast("long"), F.col("run_id").cast("long"),
                             self._bucket(F.col("message_id")).alias("bucket"))
        placed.repartition("bucket").sortWithinPartitions("bucket", "message_id").write.partitionBy("bucket").parquet(path)
        back = self._ids([segment])
        sizes = {r["bucket"]: r["n"] for r in back.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        bits = {b: bloom_size(n) for b, n in sizes.items()}
        (back.select("bucket", F.xxhash64("message_id").alias("h1"), F.xxhash64("message_id", F.lit(1)).alias("h2"))
         .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _build_blooms(b, bits), "bucket int, bits binary")
         .write.parquet(f"{self.folder}/blooms/segment={segment}"))
        return segment, sum(sizes.values())

    def stage_ids(self, ids: DataFrame, epoch: int, run_id: int) -> tuple[str, int]:
        """The ids (column ``id``) that the state does not have, as an unpublished segment; its name and size."""
        new = self.unseen(ids.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).dropDuplicates())
        return self.stage_rows(new.select(F.col("id").alias("message_id"), F.lit(epoch).alias("processed_epoch"),
                                              F.lit(run_id).alias("run_id")))

    def stage_output(self, df: DataFrame, attempt: str, name: str) -> str:
        path = f"{self.folder}/outputs/{attempt}/{name}"
        df.write.parquet(path)
        return path

    def load(self, processed: DataFrame, runs: DataFrame) -> None:
        """Start a state from existing tables."""
        segment, _ = self.stage_rows(processed)
        runs.select("id", "ran_epoch", "messages_processed").write.parquet(f"{self.folder}/runs/segment={segment}")
        self.publish(f"base-{segment}", {"segment": segment, "runs": segment})

    def compact(self) -> str | None:
        """All segments and run rows as one; published by one entry that replaces the present ones.  Runs that are
        published meanwhile are not touched."""
        before = self.entries()
        if len(before) < 2:
            return None
        segments = [e["segment"] for e in before.values() if e.get("segment")]
        runs = self.runs()
        segment, _ = self.stage_rows(self._ids(segments))
        runs.write.parquet(f"{self.folder}/runs/segment={segment}")
        self.publish(f"base-{segment}", {"segment": segment, "runs": segment, "replaces": sorted(before),
                                         "outputs": [x for e in before.values() for x in e.get("outputs", [])]})
        return segment

    def vacuum(self, older_than_seconds: int) -> list[str]:
        """Delete segments and outputs that no published entry names and that are older than the given time (what a
        running attempt writes is younger).  Ledger entries stay: they tell which runs were published."""
        import time

        entries, gone = self.entries().values(), []
        live = {f"segment={e[k]}" for e in entries for k in ("segment", "runs") if e.get(k)}
        live |= {path.rstrip("/").split("/")[-2] for e in entries for _, path, _ in e.get("outputs", [])}
        for kind in ("ids", "blooms", "runs", "outputs"):
            p, fs = self._fs(f"{self.folder}/{kind}")
            for status in fs.listStatus(p) if fs.exists(p) else []:
                name = status.getPath().getName()
                if name not in live and status.getModificationTime() / 1000 < time.time() - older_than_seconds:
                    fs.delete(status.getPath(), True)
                    gone.append(f"{kind}/{name}")
        return gone
