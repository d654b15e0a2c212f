"""Operator 13: cheapest repair of a conversation's structure, ties resolved by prefix-doubling path ranking.

The rows of a conversation are kept (0), given the role that is due (1), deleted (2; a
must for blank and duplicate rows) or preceded by an inserted empty turn (5), so that
the role initials read ``(s?(ua)+)?``; a truncated row that stays costs 5 more.  Nodes
are (place, state) with four states: nothing yet, after ``s``, after ``u``, after ``a``.

* Cost DP: costs to the end, backwards, for all pieces of a batch together.
* Ranking: the arcs that lie on cheapest paths carry the initials D, I, K, R.  The four
  arcs of a node have different initials, so the least arc of a node is known at length
  one; then the rank of a node's least audit of length 2^(k+1) is the rank of the pair
  (its rank at length 2^k, the rank at length 2^k of the node its pointer leads to), and
  the pointer is doubled with it, until every pointer rests at an end.  Any place of any
  audit is read through the doubled pointers.

Rows are dealt by ranges of (conv_id, turn), so a conversation that holds most of the
table lies in many tasks.  A conversation that begins and ends inside a task, with at
most ``PIECE`` rows, is solved there.  All others are solved in pieces of at most
``PIECE`` rows: min-plus matrices of the pieces, costs to go at their ends, then for
each of the four entry states the piece's audit and exit state, and last one stream over
the texts that follows the states, for SHA-256 of a conversation has to read its texts
in order; it holds one batch at a time.  Both ways give the same answer.

Defined cases: a null conv_id is a conversation of its own; null role, text and turn are
one space (in the damage's key too); turns sort nulls first, rows of one turn by the
digest of their damaged role and text; an empty role has no initial and cannot be kept;
a conversation without rows after the damage has zeros, an empty audit and the digest of
the empty string; very long texts never meet in a group; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import stored

#: Rows of a piece: what is solved at once.
PIECE = 4096
#: White space, sentence ends, costs.
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The role that is due in a state, the state after it, and the
#: state after a kept row with initial s, u, a or another (-1: cannot be kept).
DUE = ("user", "user", "assistant", "user")
NEXT = np.array([2, 2, 3, 2])
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
FAR = 1 << 40
END = np.array([0, FAR, FAR, 0])
LETTERS = np.frombuffer(b" DIKR", np.uint8)

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
OPEN = "pos long, turn long, role string, text string, digest binary, initial int, blank_row boolean, cut boolean, live boolean"


# ---------------------------------------------------------------- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """The table after the fixed damage; a dropped row stays as a row that is not ``live`` and has no text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text, k = F.coalesce("role", space), F.coalesce("text", space), F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), k.alias("k"),
                                role.alias("role"), text.alias("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").when(F.col("k") > 0, F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).when(F.col("k") > 0, F.col("text")).alias("text"),
        (F.col("k") > 0).alias("live"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def described(rows: DataFrame) -> DataFrame:
    """OPEN columns but the place: digest, initial and the faults a row has by itself."""
    kept = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "role", "text",
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest"),
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        F.coalesce(kept == "", F.lit(True)).alias("blank_row"), F.coalesce(~F.right(kept, F.lit(1)).isin(".", "!", "?"), F.lit(False)).alias("cut"), "live")


# ---------------------------------------------------------------- cost DP and ranking (numpy, many pieces at once)

def with_inserts(base: np.ndarray) -> np.ndarray:
    """Costs when up to two inserted turns may come first."""
    d = base.copy()
    d[:, 2] = np.minimum(base[:, 2], INSERT + base[:, 3])
    d[:, 3] = np.minimum(base[:, 3], INSERT + base[:, 2])
    d[:, 0] = np.minimum(base[:, 0], INSERT + d[:, 2])
    d[:, 1] = np.minimum(base[:, 1], INSERT + d[:, 2])
    return d


class Pieces:
    """Rows of several pieces, one after the other: their initials, which must go, which are cut."""

    def __init__(self, sizes: np.ndarray, initial: np.ndarray, must_go: np.ndarray, cut: np.ndarray):
        self.sizes, self.must_go = sizes.astype(np.int64), must_go
        self.rows = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.slots = self.rows + np.arange(sizes.size)              # a piece has a slot before each row and one at its end
        self.target = KEEP[:, initial].T                            # (row, state) -> state after keeping
        self.stay = np.where(cut & ~must_go, CUT, 0)
        self.by_size = np.argsort(-self.sizes, kind="stable")

    def costs(self, ends: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Cost to go of every (slot, state); ``ends`` are the costs at the pieces' ends, ``final`` tells where turns
        may still be inserted at the end."""
        out = np.empty((int(self.sizes.sum()) + self.sizes.size, 4), np.int64)
        last = self.slots + self.sizes
        out[last] = np.where(final[:, None], with_inserts(ends), ends)
        ordered = self.sizes[self.by_size]
        for k in range(1, int(self.sizes.max(initial=0)) + 1):
            p = self.by_size[:np.searchsorted(-ordered, -k, side="right")]
            out[last[p] - k] = with_inserts(np.minimum.reduce(self._choices(self.rows[p] + self.sizes[p] - k, out[last[p] - k + 1])))
        return np.minimum(out, FAR)

    def _choices(self, rows: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
        """Costs of deleting, keeping and reroling the rows in each state."""
        stay, stuck = self.stay[rows][:, None], self.must_go[rows][:, None]
        to = self.target[rows]
        kept = np.where(stuck | (to < 0), FAR, stay + np.take_along_axis(after, np.maximum(to, 0), 1))
        return [DELETE + after, kept, np.where(stuck, FAR, REROLE + stay + after[:, NEXT])]

    def ranked(self, cost: np.ndarray, final: np.ndarray):
        """Label (0 at ends) and head of each node's least optimal arc, doubled pointers, ranks and audit lengths."""
        n_slots, rows = cost.shape[0], int(self.sizes.sum())
        label = np.zeros((n_slots, 4), np.int64)
        head = np.arange(n_slots * 4).reshape(-1, 4)
        last = self.slots + self.sizes
        at = np.setdiff1d(np.arange(n_slots), last, assume_unique=True)     # the slots before the rows, in row order
        mine, after = cost[at], cost[at + 1]
        removed, kept, changed = self._choices(np.arange(rows), after)
        inserted = INSERT + mine[:, NEXT]
        for code, value, to in ((4, changed, (at + 1)[:, None] * 4 + NEXT), (3, kept, (at + 1)[:, None] * 4 + np.maximum(self.target, 0)),
                                (2, inserted, at[:, None] * 4 + NEXT), (1, removed, (at + 1)[:, None] * 4 + np.arange(4))):
            best = (value == mine) & (mine < FAR)
            label[at] = np.where(best, code, label[at])
            head[at] = np.where(best, to, head[at])
        tail = last[final]
        more = cost[tail] == INSERT + cost[tail][:, NEXT]
        label[tail] = np.where(more, 2, 0)
        head[tail] = np.where(more, tail[:, None] * 4 + NEXT, head[tail])
        label, pointer = label.ravel(), head.ravel()
        rank, length, doubled = label, (label > 0).astype(np.int64), [pointer]
        while (pointer[pointer] != pointer).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
            length = length + length[pointer]
            pointer = pointer[pointer]
            doubled.append(pointer)
        return label, doubled, rank, length

    def audits(self, cost: np.ndarray, final: np.ndarray, entry: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Least audit of every piece from its entry state, and the state in which it leaves."""
        label, doubled, _, length = self.ranked(cost, final)
        source = self.slots * 4 + entry
        sizes = length[source]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        node = np.repeat(source, sizes)
        step = np.arange(node.size) - np.repeat(starts[:-1], sizes)
        for k, pointer in enumerate(doubled):
            take = (step >> k & 1).astype(bool)
            node[take] = pointer[node[take]]
        letters = LETTERS[label[node]].tobytes().decode()
        return [letters[a:b] for a, b in zip(starts, starts[1:])], doubled[-1][source] % 4


def facts(conv: np.ndarray, n: int, turn: np.ndarray, known: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Columns blank, duplicate, truncated, illegal pairs, distinct turns, least and greatest turn of conversations 0 to n-1."""
    out = np.zeros((n, 7), np.int64)
    for k in range(3):
        out[:, k] = np.bincount(conv[fault == k + 1], minlength=n)
    same = conv[1:] == conv[:-1]
    a, b = initial[:-1], initial[1:]
    legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    out[:, 3] = np.bincount(conv[1:][same & ~legal], minlength=n)
    c, t = conv[known], turn[known]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])]) if c.size else np.zeros(0, bool)
    out[:, 4] = np.bincount(c[new], minlength=n)
    np.minimum.at(low := np.full(n, np.iinfo(np.int64).max), c, t)
    np.maximum.at(high := np.full(n, np.iinfo(np.int64).min), c, t)
    out[:, 5], out[:, 6] = low, high
    return out


class Repair:
    """Writes a repaired conversation into a digest, edit by edit, following the states."""

    def __init__(self):
        self.sha, self.state, self.first = hashlib.sha256(), 0, True

    def line(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        self.line(DUE[self.state], "")
        self.state = int(NEXT[self.state])

    def row(self, edit: str, role: str, text: str, initial: int) -> None:
        if edit == "K":
            self.line(role, text)
            self.state = int(KEEP[self.state, initial])
        elif edit == "R":
            self.line(DUE[self.state], text)
            self.state = int(NEXT[self.state])


def solved(rows: pa.Table, starts: np.ndarray) -> list[tuple]:
    """RESULT of whole conversations, which begin at ``starts``."""
    n = starts.size
    conv_all = np.repeat(np.arange(n), np.diff([*starts, rows.num_rows]))
    ids = rows.column("conv_id").take(pa.array(starts)).to_pylist()
    live = rows.column("live").to_numpy()
    rows, conv = rows.filter(pa.array(live)), conv_all[live]
    initial = rows.column("initial").to_numpy()
    blank = rows.column("blank_row").to_numpy()
    cut = rows.column("cut").to_numpy() & ~blank
    seen = pd.DataFrame({"c": conv, "d": rows.column("digest").to_pandas()}).duplicated().to_numpy() & ~blank
    fault = np.where(blank, 1, np.where(seen, 2, np.where(cut, 3, 0)))
    known = ~rows.column("turn").is_null().to_numpy()
    turn = rows.column("turn").fill_null(0).to_numpy()
    numbers = facts(conv, n, turn, known, initial, fault)
    sizes = np.bincount(conv, minlength=n)
    pieces, final = Pieces(sizes, initial, (fault == 1) | (fault == 2), fault == 3), np.ones(n, bool)
    cost = pieces.costs(np.tile(END, (n, 1)), final)
    audits, _ = pieces.audits(cost, final, np.zeros(n, np.int64))
    roles, texts, at, out = rows.column("role").to_pylist(), rows.column("text").to_pylist(), 0, []
    for i in range(n):
        repair = Repair()
        for edit in audits[i]:
            if edit == "I":
                repair.insert()
            else:
                repair.row(edit, roles[at], texts[at], initial[at])
                at += 1
        out.append((ids[i], *result(numbers[i]), int(cost[pieces.slots[i], 0]), audits[i], repair.sha.hexdigest()))
    return out


def result(f) -> tuple:
    """gaps, blank, duplicate, truncated, illegal of the facts of one conversation."""
    gaps = int(f[6]) - int(f[5]) + 1 - int(f[4]) if f[4] else 0
    return gaps, *(int(x) for x in f[:4])


# ---------------------------------------------------------------- Spark

def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_RESULT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2


def solve_or_pass_on(batches, piece: int):
    """Whole conversations of a sorted partition are solved; rows of its first and last conversation, which may go on in
    other partitions, and of those with more than ``piece`` rows are passed on."""
    done, kept = _fields(RESULT), _fields(OPEN)
    held, first, passing = None, True, False        # rows of the conversation that is being read; is it passed on already?

    def results(rows):
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), _RESULT_TYPES)]
        return _filled(dict(zip(done, cols)), len(rows))

    def opened(rows):
        return [b for b in _filled({c: rows.column(c) for c in ["conv_id", *kept]}, rows.num_rows).to_batches() if b.num_rows]

    for b in batches:
        rows = pa.Table.from_batches([b])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        ids = rows.column("conv_id")
        null = ids.is_null().to_numpy()
        ids = ids.fill_null(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1])
        if (first or passing) and starts.size > 1:  # the head conversation ends here
            yield from opened(rows.slice(0, starts[1]))
            rows, starts, first, passing = rows.slice(starts[1]), starts[1:] - starts[1], False, False
        whole, tail = rows.slice(0, starts[-1]), rows.slice(starts[-1])
        if whole.num_rows:
            large = np.diff(starts) > piece
            for i in np.flatnonzero(large):
                yield from opened(whole.slice(starts[i], starts[i + 1] - starts[i]))
            if not large.all():
                sizes = np.diff(starts)
                mine = whole.filter(pa.array(np.repeat(~large, sizes))).combine_chunks() if large.any() else whole
                yield from results(solved(mine, np.concatenate([[0], np.cumsum(sizes[~large])[:-1]]))).to_batches()
        if first or passing or tail.num_rows > piece or tail.nbytes > 32 << 20:
            passing, first = True, False
            yield from opened(tail.slice(0, tail.num_rows - 1))
            held = tail.slice(tail.num_rows - 1)    # one row tells whether the conversation goes on
        else:
            held = tail
    if held is not None and held.num_rows:
        yield from opened(held)


def _filled(cols: dict, n: int) -> pa.Table:
    """A table with the columns of RESULT and OPEN, null where not given."""
    types = dict(zip(_fields(RESULT), _RESULT_TYPES)) | dict(zip(_fields(OPEN), [
        pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]))
    return pa.table({c: cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in types.items()})


def _piece_rows(pdf: pd.DataFrame) -> Pieces:
    fault = pdf["fault"].to_numpy()
    return Pieces(np.array([len(pdf)]), pdf["initial"].to_numpy(), (fault == 1) | (fault == 2), fault == 3)


def _measure(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a piece: its min-plus matrix, facts, and what stands at its borders."""
    pdf = pdf.sort_values("pos")
    pieces, no = _piece_rows(pdf), np.zeros(1, bool)
    matrix = []
    for s in range(4):
        unit = np.full((1, 4), FAR)
        unit[0, s] = 0
        matrix.append(pieces.costs(unit, no)[0])
    known = pdf["turn"].notna().to_numpy()
    turn = pdf["turn"].fillna(0).to_numpy().astype(np.int64)
    f = facts(np.zeros(len(pdf), np.int64), 1, turn, known, pdf["initial"].to_numpy(), pdf["fault"].to_numpy())[0]
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1].astype("Int64"), "piece": pdf["piece"].iloc[:1],
                         "matrix": [np.array(matrix).T.ravel()],    # [entry, exit]
                         "facts": [f], "borders": [pdf["initial"].iloc[[0, -1]].to_numpy().astype(np.int64)]})


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each piece of a conversation, and the conversation's numbers."""
    pdf = pdf.sort_values("piece")
    f, borders = np.stack(pdf["facts"].to_list()), np.stack(pdf["borders"].to_list())
    total = np.concatenate([f[:, :5].sum(0), [f[:, 5].min(), f[:, 6].max()]])
    for a, b in zip(range(len(f)), range(1, len(f))):
        total[3] += (int(borders[a, 1]), int(borders[b, 0])) not in ((0, 1), (1, 2), (2, 1))
        total[4] -= bool(f[a, 4] and f[b, 4] and f[a, 6] == f[b, 5])
    go, ends = with_inserts(END[None])[0], []
    for m in reversed(pdf["matrix"].to_list()):
        ends.append(go)
        go = (np.reshape(m, (4, 4)) + go).min(1)
    gaps, blank, duplicate, truncated, illegal = result(total)
    return pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "piece": pdf["piece"], "go": [np.array(e) for e in reversed(ends)],
                         "final": [*[False] * (len(f) - 1), True], "gaps": gaps, "blank": blank, "duplicate": duplicate,
                         "truncated": truncated, "illegal": illegal, "cost": int(go[0])})


def _audit(pdf: pd.DataFrame, scan: pd.DataFrame) -> pd.DataFrame:
    """Audit and exit state of a piece for each entry state."""
    if not len(pdf):
        return scan.assign(audits=None, exits=None)[:0]
    pieces, final = _piece_rows(pdf.sort_values("pos")), scan["final"].to_numpy()
    ends = END[None] if final[0] else np.stack(scan["go"].to_list())
    cost = pieces.costs(ends, final)
    each = [pieces.audits(cost, final, np.array([s])) for s in range(4)]
    return scan.assign(audits=[[a[0] for a, _ in each]], exits=[[int(x[0]) for _, x in each]])


def _follow(batches):
    """RESULT of conversations from their pieces' audits (first of a piece) and their texts, in order."""
    now, repair, audit, at, whole, numbers, any_row = None, None, "", 0, [], None, False

    def done():
        nonlocal at
        while at < len(audit):
            repair.insert()
            at += 1
        return (now[0], *(numbers or (0,) * 6), "".join(whole), repair.sha.hexdigest())

    for b in batches:
        out = []
        for conv, audits, exits, nums, role, text, initial, live in zip(*[b.column(c).to_pylist() for c in (
                "conv_id", "audits", "exits", "numbers", "role", "text", "initial", "live")]):
            if not any_row or now[0] != conv:
                if any_row:
                    out.append(done())
                now, repair, audit, at, whole, numbers, any_row = (conv,), Repair(), "", 0, [], None, True
            if audits is not None:
                audit, at, numbers = audits[repair.state], 0, tuple(nums)
                whole.append(audit)
            elif live:
                while audit[at] == "I":
                    repair.insert()
                    at += 1
                repair.row(audit[at], role, text, initial)
                at += 1
        if out:
            yield _results(out)
    if any_row:
        yield _results([done()])


def _results(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RESULT_TYPES)], _fields(RESULT))


def across_pieces(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """RESULT of the conversations of ``rows`` (conv_id and OPEN), solved in pieces of at most ``piece`` rows (a power of two)."""
    number = F.shiftright("pos", piece.bit_length() - 1).alias("piece")
    live = rows.where("live").select("*", number)
    seen = (live.where("NOT blank_row").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d"))
            .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    narrow = live.drop("role", "text", "live").join(
        seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & ~F.col("blank_row"), "left").select(
        "conv_id", "piece", "pos", "turn", "initial",
        F.when(F.col("blank_row"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut"), 3).otherwise(0).alias("fault"))
    narrow = stored(narrow, "repair-rows")
    measured = narrow.groupBy("conv_id", "piece").applyInPandas(
        _measure, "conv_id long, piece long, matrix array<long>, facts array<long>, borders array<long>")
    scan = "conv_id long, piece long, go array<long>, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    scanned = measured.groupBy("conv_id").applyInPandas(_scan, scan)
    audited = narrow.groupBy("conv_id", "piece").cogroup(scanned.groupBy("conv_id", "piece")).applyInPandas(
        _audit, scan + ", audits array<string>, exits array<int>")
    none = lambda t: F.lit(None).cast(t)
    heads = audited.select("conv_id", "piece", F.lit(-1).cast("long").alias("pos"), "audits", "exits",
                           F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("numbers"),
                           none("string").alias("role"), none("string").alias("text"), none("int").alias("initial"), F.lit(True).alias("live"))
    texts = rows.select("conv_id", number, "pos", none("array<string>").alias("audits"),
                        none("array<int>").alias("exits"), none("array<long>").alias("numbers"), "role", "text", "initial", "live")
    return (heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos")
            .mapInArrow(_follow, RESULT))


def repair_conversations(conversations: DataFrame, damage=damaged, piece: int = PIECE) -> DataFrame:
    """RESULT of every conversation after ``damage`` (which returns conv_id, turn, role, text, live)."""
    order = ["conv_id", "turn", "digest"]
    rows = described(damage(conversations)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id())
    rows = rows.select("conv_id", *_fields(OPEN))
    told = stored(rows.mapInArrow(lambda batches: solve_or_pass_on(batches, piece), f"{RESULT}, {OPEN}"), "repair-told")
    return told.where("pos IS NULL").select(*_fields(RESULT)).unionByName(
        across_pieces(told.where("pos IS NOT NULL").select("conv_id", *_fields(OPEN)), piece))
