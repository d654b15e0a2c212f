"""Operator 4: MinHash near-duplicates with tensored banding.

A document's set is its distinct shingles of ``shingle`` words.  Two collections
of ``SIDE`` half keys are made, each half key from ``HALF`` minhashes; the key of
table (i, j) combines half key i of the first collection with half key j of the
second.  SIDE * SIDE tables of 2 * HALF minhashes each so need only
2 * SIDE * HALF minhashes, about a square root of what separate tables would.
A pair of similarity 0.8 meets in some table with probability over 0.999.

Documents with one and the same set are one class from the start; only class
representatives enter the tables.  First each member of a table entry is held
against the entry's smallest id, the few best supported of these pairs are kept
where the minhashes agree enough, and the best of each member is verified.  The
kept pairs also tie documents into families.  Then every entry whose members are
of more than one family is looked through in full: in blocks, pair of blocks by
pair of blocks, the minhashes of all its members of different families are
compared, and what agrees enough ties their families too.  So two documents that
share an entry and agree enough are always of one family.  A family
that is not yet one component is compared fully: its members are dealt into
blocks, every pair of blocks goes to one task with the members' full sets, and
the task counts common shingles of all its cross-component pairs and returns
only the links that join components.  Links are confirmed on full sets
(100 * common >= percent * union).  Sets, candidates and links stay distributed;
intermediate tables are written to the shared folder.

Defined cases: an empty set (no words, empty or null text) is linked with
nothing; fewer words than a shingle make one shingle of the whole sequence.  A
document is identified by doc_id: rows that repeat one are one document (the
text of the smallest set hash stands for it), rows with a null doc_id are linked
with nothing and not returned.  Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.llm.common import (ascii_words, by_bucket, in_portions, mix64, pack_sorted, release, shuffle_partitions, stored,
                               unpack_sorted, word_hashes)

HALF, SIDE = 3, 12
HASHES = 2 * HALF * SIDE
#: Minhash agreement that ties two documents into a family: five standard deviations under 0.8.
LEAST_AGREEMENT = 0.55
#: Pairs kept of each member, best supported first; members of a family's block.
KEPT_PAIRS = 4
BLOCK_MEMBERS = 256
#: Members of a block of a table entry; groups of one-block entries for each bucket of the tables.
ENTRY_BLOCK = 2048
ENTRY_GROUPS = 16
#: Characters of text that are hashed at once.
PORTION = 1 << 20
#: Links that one task may join (a few megabytes).
ONE_TASK_LINKS = 500_000
#: Table entries of a bucket, about; members of one entry that are listed together.
BUCKET_ENTRIES = 2_000_000
LISTED = 1 << 14

_SEED = np.random.default_rng(20_010_101)
MULTIPLIERS = _SEED.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEED.integers(0, 1 << 63, HASHES, dtype=np.uint64)
TABLE_SALTS = mix64(np.arange(SIDE * SIDE, dtype=np.uint64) + np.uint64(0x51ED270B))


# ---------------------------------------------------------------- sets and minhashes inside tasks

def shingle_sets(texts, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = [ascii_words(t) for t in texts]
    h = word_hashes([w for own in words for w in own])
    grams = h.copy()
    for k in range(1, shingle):
        tail = h[k:]
        grams[:tail.size] = mix64(grams[:tail.size]) + tail * np.uint64(0x9E3779B97F4A7C15)
    out, at = [], 0
    for own in words:
        n = len(own)
        if n >= shingle:
            out.append(np.unique(grams[at:at + n - shingle + 1]))
        elif n:
            whole = np.uint64(n)
            for x in h[at:at + n]:
                whole = mix64(np.array([whole]))[0] ^ x
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix64(s ^ np.uint64(0x2545F4914F6CDD1D)), mix64(s + np.uint64(0x9E3779B97F4A7C15))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(b, initial=np.uint64(0)).view(np.int64))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES 32-bit minhashes for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(s.size for s in sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    mixed = mix64(flat)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(((mixed ^ OFFSETS[j]) * MULTIPLIERS[j]) >> np.uint64(32), starts)
    return out


def table_keys(sig: np.ndarray) -> np.ndarray:
    """Key of every table for every row: half key i of the one with half key j of the other collection."""
    parts = sig.astype(np.uint64).reshape(len(sig), 2, SIDE, HALF)
    half = np.zeros(parts.shape[:3], np.uint64)
    for k in range(HALF):
        half = mix64(half + parts[..., k] + np.uint64(k + 1))
    pairs = half[:, 0, :, None] * np.uint64(0x9E3779B97F4A7C15) + half[:, 1, None, :]
    return mix64(pairs.reshape(len(sig), SIDE * SIDE) ^ TABLE_SALTS)


def _portions(batches):
    """The batches, cut to about a million characters of text each."""
    release()
    for b in batches:
        for i, j in in_portions(b.column(1).to_pylist(), PORTION):
            yield b.slice(i, j - i)


def _sketch(shingle: int):
    def run(batches):
        for b in _portions(batches):
            sets = shingle_sets(b.column(1).to_pylist(), shingle)
            sizes = np.array([s.size for s in sets], np.int64)
            full = [s for s in sets if s.size]
            rows = iter(minhashes(full)) if full else iter(())
            sigs = [next(rows).tobytes() if n else b"" for n in sizes]
            one, two = zip(*map(set_hash, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                              pa.array(sigs, pa.binary())], ["doc_id", "n", "s1", "s2", "sig"])
    return run


def _fill_tables(buckets: int, rows_at_once: int = 8000):
    """Packed entries of the tables: for each bucket of the key space the sorted keys and their ids."""
    def cells(ids: list, sigs: list) -> pa.RecordBatch:
        keys = table_keys(np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, HASHES)).ravel()
        owner = np.repeat(np.array(ids, np.int64), SIDE * SIDE)
        by = np.argsort(keys)
        keys, owner = keys[by], owner[by]
        cut = by_bucket(keys, buckets)
        return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in cut], pa.int32()),
                                           "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in cut], pa.binary()),
                                           "ids": pa.array([owner[i:j].tobytes() for _, i, j in cut], pa.binary())})

    def run(batches):
        ids, sigs = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            sigs += b.column(1).to_pylist()
            if len(ids) >= rows_at_once:
                yield cells(ids, sigs)
                ids, sigs = [], []
        if ids:
            yield cells(ids, sigs)
    return run


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The table entries of a bucket that more than one representative shares, equal ones once with their number.

    ``entry`` is a hash of all members."""
    keys = np.concatenate([unpack_sorted(k) for k in pdf["keys"]])
    ids = np.concatenate([np.frombuffer(i, np.int64) for i in pdf["ids"]])
    by = np.lexsort((ids, keys))
    keys, ids = keys[by], ids[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [keys.size]]))
    seen: dict[tuple[int, bytes], int] = {}
    for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = ids[a:a + n]
        entry = int.from_bytes(blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
        # a very long entry is listed in portions, its smallest id in each
        for c in range(1, n, LISTED):
            part = entry, np.concatenate([members[:1], members[c:c + LISTED]]).tobytes()
            seen[part] = seen.get(part, 0) + 1
    return pd.DataFrame({"entry": np.array([e for e, _ in seen], np.int64), "members": [np.frombuffer(m, np.int64) for _, m in seen],
                         "times": list(seen.values())})


# ---------------------------------------------------------------- candidates, verification, components

def _percent_ok(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = unpack_sorted(x), unpack_sorted(y)
                common = np.intersect1d(x, y, assume_unique=True).size
                ok.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _sets_of(shingle: int):
    def run(batches):
        for b in _portions(batches):
            sets = shingle_sets(b.column(1).to_pylist(), shingle)
            keep = [set_hash(s) == (x, y) for s, x, y in zip(sets, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(pack_sorted, sets), pa.binary())], ["id", "set"]).filter(
                pa.array(keep, pa.bool_()))
    return run


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the wanted documents (id, s1, s2, copies), stored."""
    joined = rows.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id")
    sets = joined.where("copies = 1").select("doc_id", "text", "s1", "s2").mapInArrow(_sets_of(shingle), "id long, set binary")
    if wanted.where("copies > 1").limit(1).count():
        more = joined.where("copies > 1").select("doc_id", "text", "s1", "s2").mapInArrow(_sets_of(shingle), "id long, set binary")
        sets = sets.unionAll(more.dropDuplicates(["id"]))
    return stored(sets, "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_percent_ok(percent), "a long, b long")


def _agreeing(batches):
    """Pairs whose minhashes agree enough for one family."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("x", "y"))
        yield b.select(["a", "b", "times"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT, pa.bool_()))


def _low_bytes(batches):
    """The lowest byte of every minhash: equal ones stay equal, unequal ones meet once in 256."""
    for b in batches:
        low = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low, pa.binary())], ["id", "low"])


def _ties(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs that agree enough and join different families, as few as join them, of every pair of blocks (entry, lo, hi)."""
    out = []
    for (_, lo, hi), own in pdf.groupby(["entry", "lo", "hi"], sort=False):
        ids, block = own["id"].to_numpy(), own["block"].to_numpy()
        low = np.frombuffer(b"".join(own["low"]), np.uint8).reshape(-1, HASHES)
        _, family = np.unique(own["family"].to_numpy(), return_inverse=True)
        right = np.flatnonzero(block == hi)
        columns = np.ascontiguousarray(low[right].T)
        for i in np.flatnonzero(block == lo):
            other = family[right] != family[i]
            if not other.any():
                continue
            agree = (columns == low[i][:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8)
            met = right[other & (agree >= LEAST_AGREEMENT * HASHES)]
            for f, at in zip(*np.unique(family[met], return_index=True)):
                out.append((ids[i], ids[met[at]]))
                family[family == f] = family[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def family_ties(entries: DataFrame, families: DataFrame, reps: DataFrame, groups: int) -> DataFrame:
    """Pairs (a, b) that tie further families: of all members of a table entry that are of different
    families (id, family) and agree enough, as few as join these families."""
    listed = entries.select("entry", F.explode("members").alias("id")).distinct()
    listed = listed.join(families, "id", "left").withColumn("family", F.coalesce("family", "id"))
    sizes = listed.groupBy("entry").agg(F.count(F.lit(1)).alias("size"), F.min("family").alias("x"), F.max("family").alias("y"))
    open_ = sizes.where("x < y").select("entry", F.ceil(F.col("size") / ENTRY_BLOCK).alias("blocks"))
    members = listed.join(open_, "entry").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    low = reps.select("id", "sig").mapInArrow(_low_bytes, "id long, low binary")
    paired = members.join(low, "id").select("entry", "id", "family", "low", "block", "blocks", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    paired = paired.select("entry", "id", "family", "low", "block", "blocks", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"))
    alone = F.pmod(F.xxhash64("entry"), F.lit(groups))
    group = F.when(F.col("blocks") == 1, F.struct(alone.alias("e"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))).otherwise(
        F.struct(F.col("entry").alias("e"), "lo", "hi"))
    return paired.withColumn("g", group).select("g.e", F.col("g.lo").alias("l"), F.col("g.hi").alias("h"), "entry", "id", "family", "low",
                                                "block", "lo", "hi").groupBy("e", "l", "h").applyInPandas(_ties, "a long, b long")


def _block_links(percent: int):
    """Links between different components within a pair of blocks of a family, as few as join them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        ids, label, block = (pdf[c].to_numpy() for c in ("id", "label", "block"))
        sets = [unpack_sorted(x) for x in pdf["set"]]
        sizes = np.array([s.size for s in sets])
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        codes = np.split(code, np.cumsum(sizes)[:-1])
        right = np.flatnonzero(block == hi)
        if not right.size:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        flat = np.concatenate([codes[i] for i in right])
        starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
        present = np.zeros(distinct.size, bool)
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        out = []
        for i in np.flatnonzero(block == lo):
            other = label[right] != label[i]
            if not other.any():
                continue
            present[codes[i]] = True
            common = np.add.reduceat(present[flat], starts)
            present[codes[i]] = False
            for j in right[other & (100 * common >= percent * (sizes[i] + sizes[right] - common))]:
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def families_of(ties: DataFrame) -> DataFrame:
    """(id, family) of the pairs (a, b), stored."""
    return stored(components(ties).select("id", F.col("label").alias("family")), "near-families")


def family_links(families: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of every family that has more than one."""
    members = families.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y"))
    blocks = F.ceil(F.col("size") / BLOCK_MEMBERS)
    open_ = sizes.where("x < y").select("family", blocks.alias("blocks"))
    members = members.join(open_, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    paired = members.select("family", "id", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    paired = paired.select("family", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "id", "label", "block")
    return paired.join(sets, "id").groupBy("family", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long")


def _union(frames):
    """Union-find over the links of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in frames:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    ids = list(parent)
    yield pd.DataFrame({"id": ids, "label": [root(x) for x in ids]}, dtype="int64")


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(id, label): the smallest id of the component, for every id that has a link.

    Up to ``one_task`` links (counted first) one task joins them.  More links are contracted
    in distributed rounds of alternating stars: all larger neighbours of an id, then it and its
    smaller ones, are tied to the smallest id around, until nothing changes."""
    def smallest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def digest(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "near-links")
    state = digest(edges)
    if state[0] <= one_task:
        return edges.coalesce(1).mapInPandas(_union, "id long, label long")
    while True:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = around.join(smallest(around), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.join(smallest(large), "u")
        small = low.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "near-stars")
        before, state = state, digest(edges)
        if before == state:
            break
    label = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
    return label.unionAll(label.select(F.col("label").alias("id"), "label").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sketched = rows.mapInArrow(_sketch(shingle), "doc_id long, n long, s1 long, s2 long, sig binary")
    own = stored(sketched.groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n", "sig")).alias("x"), F.count(F.lit(1)).alias("copies"))
                 .select("doc_id", "x.*", "copies"), "near-sketches")
    reps = stored(own.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "sig", "copies")).alias("x"))
                  .select(F.col("x.doc_id").alias("id"), "s1", "s2", "x.n", "x.sig", "x.copies"), "near-classes")
    buckets = max(shuffle_partitions(spark), -(-reps.count() * SIDE * SIDE // BUCKET_ENTRIES))
    cells = reps.select("id", "sig").mapInArrow(_fill_tables(buckets), "bucket int, keys binary, ids binary")
    entries = stored(cells.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _entries, "entry long, members array<long>, times int"), "near-entries")
    # every member against the smallest id of its entries
    star = entries.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, LISTED)).alias("b"), "times").groupBy(
        "a", "b").agg(F.sum("times").alias("times"))
    best = Window.partitionBy("b").orderBy(F.desc("times"), "a")
    star = star.withColumn("r", F.row_number().over(best)).where(F.col("r") <= KEPT_PAIRS).drop("r")
    sig = lambda key, name: reps.select(F.col("id").alias(key), F.col("sig").alias(name))
    star = star.join(sig("a", "x"), "a").join(sig("b", "y"), "b").mapInArrow(_agreeing, "a long, b long, times long")
    star = stored(star, "near-stars")
    # the rest of the entries' pairs
    families = families_of(star.select("a", "b"))
    more = stored(family_ties(entries, families, reps, buckets * ENTRY_GROUPS), "near-ties")
    ties = star.select("a", "b").unionAll(more)
    if more.limit(1).count():
        families = families_of(ties)
    ids = ties.select(F.col("a").alias("id")).unionAll(ties.select(F.col("b").alias("id"))).distinct()
    sets = full_sets(rows, reps.select("id", "s1", "s2", "copies").join(ids, "id"), shingle)
    first = star.groupBy("b").agg(F.min(F.struct(-F.col("times"), F.col("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = stored(verified(first, sets, percent), "near-links")
    labels = stored(components(links), "near-labels")
    links = links.unionAll(family_links(families, labels, sets, percent))
    labels = components(links)
    classes = reps.join(labels, "id", "left").select("s1", "s2", F.coalesce("label", "id").alias("component_id"))
    linked = own.where("n > 0").select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"])
    alone = own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionAll(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates of a document that stays; rows with a
    null doc_id stay."""
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
