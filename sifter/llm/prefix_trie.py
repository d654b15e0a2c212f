"""Operator 11: the prefix trie of rebuilt conversations, by ROLLUP over positional columns of turn ids.

A turn's id at a depth is 128 bits made of the digest of its role and text and of
the depth.  Conversations are cut into blocks of ``WIDTH`` turns; a block row holds
the positional id columns and the key of the node that the prior block ends in, so
all blocks of all conversations are aggregated together by one

    GROUP BY block, prior node, ROLLUP(c0, ..., c7)

in which ``grouping_id()`` tells the depth of each node.  The key of a node is the
exclusive or of the turn ids on its path, which lets prior-node keys be found by
prefix sums over blocks, in two levels, however long a conversation is.

The ROLLUP runs twice.  The first finds every node's smallest member.  A
conversation is the smallest member of a node and of everything below it on its own
path, so each conversation *owns* the nodes from one depth on, which gives it three
numbers: that depth, the characters before it, and whether its end is a leaf.  Sums
of these over the members of a node are its subtree sums (second ROLLUP): the leaves
below are the owned leaves of its members, and the characters saved are what its
other members share with smaller ones from its depth on.

Nothing of a conversation or of a node meets in one task but partial sums: turns are
numbered by range partitions, joins on hot keys are split by AQE, and the digests of
end lists stream over sorted pieces.

Defined cases: rows without conv_id belong to no conversation and are left out; null
role or text is empty; turns are ordered by turn (null first), equal turns by the
digest of role and text; repeated rows are repeated turns; a conversation left without
turns is a member of the root; very long texts are digested in their row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sifter.llm.common import stored
from sifter.operators.ordering import ordered_position

#: Turn columns of a block, blocks whose prefix sums are found together.
WIDTH = 8
SPAN = 1024

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "kh", "kl"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place in the whole order, digest, chars) of every turn; texts do not move."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars"))
    return ordered_position(rows, ["conv_id", "turn", "digest"]).drop("turn")


def rebuilt(turns: DataFrame, shared=lambda c: F.crc32(c.cast("string").cast("binary")) % 6, group: int = 100) -> DataFrame:
    """(conv_id, n_turns, depth, digest, chars): the first ``shared`` turns of the conversation that leads the group,
    then the own ones after that many, and a row of depth 0 for every conversation."""
    convs = turns.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), shared(F.col("conv_id")).alias("h"))
    leads = (turns.where(F.col("conv_id") % group == 0).join(convs.select("conv_id", "first", F.col("n").alias("n_base")), "conv_id")
             .where(F.col("pos") - F.col("first") < 5)
             .groupBy(F.col("conv_id").alias("base")).agg(
                 F.max("n_base").alias("n_base"), F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("lead")))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(leads, "base", "left").select(
        "conv_id", "first", "h", taken.alias("taken"), "lead", (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    own = (turns.join(convs.drop("lead"), "conv_id").where(F.col("pos") - F.col("first") >= F.col("h"))
           .select("conv_id", "n_turns", (F.col("pos") - F.col("first") + 1 + F.col("taken") - F.col("h")).alias("depth"), "digest", "chars"))
    lead = convs.where("taken > 0").select("conv_id", "n_turns", F.posexplode(F.slice("lead", F.lit(1), F.col("taken").cast("int")))).select(
        "conv_id", "n_turns", (F.col("pos") + 1).cast("long").alias("depth"), "col.digest", "col.chars")
    root = convs.select("conv_id", "n_turns", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                        F.lit(0).cast("long").alias("chars"))
    return own.unionByName(lead).unionByName(root)


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block: conv_id, n_turns, block, key (ph, pl) and characters (pc) of what lies before it, c0 to c7,
    and the block's own (xh, xl, xc)."""
    ids = rows.select("conv_id", "n_turns", F.floor((F.greatest("depth", F.lit(1)) - 1) / WIDTH).alias("block"), F.when(
        F.col("depth") > 0, F.struct("depth", F.xxhash64("digest", "depth").alias("zh"),
                                     F.xxhash64("depth", "digest", F.lit(1)).alias("zl"), "chars")).alias("t"))
    own = ids.groupBy("conv_id", "block").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list("t")).alias("ts"))

    def total(field, start=0, op=lambda a, b: a + b):
        return F.aggregate("ts", F.lit(start).cast("long"), lambda a, t: op(a, t[field]))

    own = own.select("conv_id", "block", "n_turns", F.floor(F.col("block") / SPAN).alias("span"),
                     *[F.get("ts", F.lit(j)).dropFields("depth").alias(f"c{j}") for j in range(WIDTH)],
                     total("zh", op=lambda a, b: a.bitwiseXOR(b)).alias("xh"), total("zl", op=lambda a, b: a.bitwiseXOR(b)).alias("xl"),
                     total("chars").alias("xc"))
    sums = [("h", F.bit_xor), ("l", F.bit_xor), ("c", F.sum)]
    spans = own.groupBy("conv_id", "span").agg(*[f(f"x{k}").alias(f"x{k}") for k, f in sums])
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", *[f(f"x{k}").over(before).alias(f"s{k}") for k, f in sums]).where("span > 0")
    within = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", *[F.coalesce(f(f"x{k}").over(within), F.lit(0)).alias(f"w{k}") for k, f in sums])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(spans, ["conv_id", "span"], "left").select(
        "conv_id", "n_turns", "block", F.col("wh").bitwiseXOR(zero(F.col("sh"))).alias("ph"),
        F.col("wl").bitwiseXOR(zero(F.col("sl"))).alias("pl"), (F.col("wc") + zero(F.col("sc"))).alias("pc"),
        *[f"c{j}" for j in range(WIDTH)], "xh", "xl", "xc")


def rolled_up(block_rows: DataFrame, measures: str) -> DataFrame:
    """A row for each node: KEY, the parent's key (uh, ul), characters before its last turn (prefix), and the measures
    aggregated over its members.  Places that a shorter conversation has not, and roots of later blocks, are no nodes."""
    cols = [f"c{j}" for j in range(WIDTH)]
    real = " ".join(f"WHEN grouping_id() & {1 << (WIDTH - 1 - j)} = 0 THEN c{j} IS NOT NULL" for j in reversed(range(WIDTH)))
    up = block_rows.sparkSession.sql(
        f"SELECT block, ph, pl, max(pc) AS pc, {', '.join(cols)}, {WIDTH} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{rows}} GROUP BY block, ph, pl, ROLLUP({', '.join(cols)}) HAVING CASE {real} ELSE block = 0 END", rows=block_rows)
    path = F.array(*cols)

    def key(field, start):
        return F.aggregate(path, F.col(start), lambda a, c: a.bitwiseXOR(F.coalesce(c[field], F.lit(0))))

    last = F.get(path, F.col("level") - 1)
    up = up.withColumns({"kh": key("zh", "ph"), "kl": key("zl", "pl"), "last": last,
                         "all": F.aggregate(path, F.col("pc"), lambda a, c: a + F.coalesce(c["chars"], F.lit(0)))})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return up.withColumns({
        "depth": F.col("block") * WIDTH + F.col("level"), "uh": F.col("kh").bitwiseXOR(zero(F.col("last.zh"))),
        "ul": F.col("kl").bitwiseXOR(zero(F.col("last.zl"))), "prefix": F.col("all") - zero(F.col("last.chars"))}).drop(
        "block", "ph", "pl", "pc", *cols, "level", "last", "all")


def end_lists(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of every node in which a conversation ends: ids are sorted over range partitions, joined to
    pieces there, and the pieces of a node stream through one digest."""
    names = [*KEY, "conv_id"]

    def join(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, at = list(zip(*[b.column(c).to_pylist() for c in range(4)])), 0
            out = []
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i][:3] != rows[at][:3]:
                    out.append((*rows[at], ",".join(str(r[3]) for r in rows[at:i])))
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out))],
                                             [*names, "ids"])

    def digest(batches):
        now, sha = None, None

        def done(keys):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*keys))],
                                              [*KEY, "ends_sha256"])

        for b in batches:
            out = []
            for *key, ids in zip(*[b.column(c).to_pylist() for c in (0, 1, 2, 4)]):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield done(out)
        if now is not None:
            yield done([(*now, sha.hexdigest())])

    pieces = (ends.select(*names).repartitionByRange(*names).sortWithinPartitions(*names)
              .mapInArrow(join, "depth long, kh long, kl long, conv_id long, ids string"))
    return (pieces.repartition(*KEY).sortWithinPartitions(*names)
            .mapInArrow(digest, "depth long, kh long, kl long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    block_rows = stored(blocks(rebuilt(numbered_turns(conversations))), "trie-blocks")
    nodes = stored(rolled_up(block_rows, "min(conv_id) AS conv_id, max(n_turns) AS longest"), "trie-nodes")

    # from which depth a conversation owns its nodes, below which parent, and whether its end is a leaf
    owners = stored(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owned"), F.min_by("prefix", "depth").alias("apart"), F.min_by("uh", "depth").alias("uh"),
        F.min_by("ul", "depth").alias("ul"), F.max_by(F.col("longest") == F.col("depth"), "depth").alias("leaf")), "trie-owners")
    root = nodes.where("depth = 0").select("conv_id").first()
    top = F.lit(root["conv_id"] if root else None).cast("long")
    above = nodes.select((F.col("depth") + 1).alias("owned"), F.col("kh").alias("uh"), F.col("kl").alias("ul"), F.col("conv_id").alias("under"))
    deep = owners.where("owned > 1").join(above.where("owned > 1"), ["owned", "uh", "ul"]).select("conv_id", "under")
    whole = block_rows.groupBy("conv_id").agg(F.max("n_turns").alias("depth"), F.bit_xor("xh").alias("kh"), F.bit_xor("xl").alias("kl"),
                                              F.sum("xc").alias("chars"))
    members = whole.join(owners.drop("uh", "ul"), "conv_id", "left").join(deep, "conv_id", "left").select(
        "conv_id", "owned", F.coalesce("apart", "chars").alias("apart"), F.coalesce(F.col("leaf").cast("long"), F.lit(0)).alias("leaf"),
        F.when(F.col("owned") == 1, top).otherwise(F.col("under")).alias("under"))
    up = rolled_up(block_rows.join(members, "conv_id"),
                   "min(conv_id) AS conv_id, count(*) AS n_convs, min_by(n_turns, conv_id) AS n_turns, min_by(owned, conv_id) AS owned, "
                   "min_by(under, conv_id) AS under, min_by(apart, conv_id) AS own_apart, sum(apart) AS apart, sum(leaf) AS n_leaves")

    none = F.lit(None).cast("string")
    branches = owners.where("owned > 0").groupBy((F.col("owned") - 1).alias("depth"), F.col("uh").alias("kh"), F.col("ul").alias("kl")).agg(
        F.count(F.lit(1)).alias("branches")).withColumn("ends_sha256", none)
    ends = end_lists(whole).withColumn("branches", F.lit(0).cast("long"))
    extra = branches.unionByName(ends).groupBy(*KEY).agg(F.sum("branches").alias("branches"), F.max("ends_sha256").alias("ends_sha256"))
    return up.join(extra, KEY, "left").select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.when(F.col("owned") < F.col("depth"), F.col("conv_id")).otherwise(F.col("under"))).alias("parent_conv_id"),
        "n_convs", (F.coalesce("branches", F.lit(0)) + (F.col("n_turns") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("apart") - F.col("own_apart") - (F.col("n_convs") - 1) * F.col("prefix")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
