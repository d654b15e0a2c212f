"""Prefix trie and structure repair of conversations against brute-force versions."""

import collections
import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest

from sifter.llm import path_repair, prefix_trie
from sifter.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string, depth int, kh string, pos int, live string"


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def edge_conversations(long_one=200):
    """Nulls everywhere, gaps, equal turns, repeated rows, negative and absent leading conversations, a long one."""
    rng, rows = random.Random(1), []
    for c in [*range(130), -5, -100, -101, 250, 300, 399, 1000, 1099]:
        for t in range(long_one if c == 1099 else rng.choice([1, 2, 3, 4, 7, 8, 9, 12, 20])):
            turn = rng.choice([t, None]) if rng.random() < 0.1 else t + 5 * (rng.random() < 0.02)
            role = rng.choice(["user", "assistant", "system", "", None, "unknown"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(["a.", "bb!", "ccc", None, "é🙂.", "  ", "x? \n", ""]) if rng.random() < 0.5 else f"text {t // 3}."
            rows.append((c, turn, role if c % 7 else ("user", "assistant")[t % 2], text if c % 3 else f"{t // 3}"))
    return rows + rows[:10] + [(None, 1, "user", "x"), (None, None, None, None), (2000, 0, "user", "word " * 100_000 + ".")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 1, "clash") for r in rows], SCHEMA).repartition(5)


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


# ---------------------------------------------------------------- operator 11

def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, digest(role, text), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:]
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return by_key(out)


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = edge_conversations()
    for span in (prefix_trie.SPAN, 3):              # prefix sums in one and in several spans of blocks
        monkeypatch.setattr(prefix_trie, "SPAN", span)
        assert by_key(prefix_trie.prefix_trie(frame(spark, rows)).collect()) == brute_trie(rows)


def test_trie_of_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    assert by_key(prefix_trie.prefix_trie(t).collect()) == brute_trie(rows)


def test_trie_of_copies_and_nothing(spark):
    """A third of all conversations are the same: their end list is put together from many pieces."""
    rows = [(c, t, "user", f"turn {t} of {c if c % 3 else 'all'}") for c in range(0, 90_00, 3) for t in range(2)]
    rows += [(c, 0, "system", "alone") for c in range(1, 3000, 3)]
    got = by_key(prefix_trie.prefix_trie(frame(spark, rows).repartition(16)).collect())
    assert got == brute_trie(rows)
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_absent_places_never_reach_the_shuffle(spark):
    """Places that a shorter conversation has not are dropped between the expansion and the first aggregation."""
    rows = prefix_trie.blocks(prefix_trie.rebuilt(prefix_trie.numbered_turns(frame(spark, edge_conversations(20)))))
    plan = prefix_trie.rolled_up(rows, "min(conv_id) AS conv_id")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.strip(" +-:") for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("Expand"))
    assert lines[at - 1].startswith("Filter") and "spark_grouping_id" in lines[at - 1]


# ---------------------------------------------------------------- operator 13

def brute_repair(rows):
    conv = collections.defaultdict(list)
    for c, t, role, text in rows:
        conv[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else text
        role = "user" if k == 4 else role
        conv[c] += [(t is not None, t or 0, digest(role, text), role, text)] * (1 + (k == 3))
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = []
    for c, v in conv.items():
        v.sort()
        turns = [t for known, t, *_ in v if known]
        seen, faults = set(), []
        for *_, role, text in v:
            end = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        # cheapest first, then the least audit: Dijkstra over (place, state)
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, s, lines = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done.add((i, s))
            if i == len(v) and s in (0, 3):
                break
            due, after = ("assistant", 3) if s == 2 else ("user", 2)
            heapq.heappush(heap, (cost + 5, audit + "I", i, after, (*lines, (due, ""))))
            if i < len(v):
                role, text = v[i][3:]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, lines))
                if faults[i] not in (1, 2):
                    more = cost + 5 * (faults[i] == 3)
                    if (s, role[:1]) in keep:
                        heapq.heappush(heap, (more, audit + "K", i + 1, keep[s, role[:1]], (*lines, (role, text))))
                    heapq.heappush(heap, (more + 1, audit + "R", i + 1, after, (*lines, (due, text))))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return by_key(out)


def test_repair_equals_brute_force(spark):
    rows = edge_conversations()
    expect = brute_repair(rows)
    assert {len(r[7]) for r in expect} >= {1, 2, 20} and {"D", "K", "R"} <= set("".join(r[7] for r in expect))
    for piece in (path_repair.PIECE, 4):            # solved in one task, or in pieces of four rows
        assert by_key(path_repair.repair_conversations(frame(spark, rows), piece=piece).collect()) == expect


def test_repair_of_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    assert by_key(path_repair.repair_conversations(t).collect()) == brute_repair(rows)


def test_repair_of_one_conversation_in_many_tasks(spark):
    """A conversation with nearly all rows, and nothing left after the damage."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"line {t}."])) for t in range(6000)]
    dropped = next((c, 0) for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(*dropped, "user", "gone."), *((c, t, "user", "x.") for c in range(20, 60) for t in range(2))]
    got = {r[0]: r for r in by_key(path_repair.repair_conversations(frame(spark, rows), piece=512).collect())}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[dropped[0]] == (dropped[0], 0, 0, 0, 0, 0, 0, "", empty)
    short = [r for r in rows if r[0] != 7]
    assert [got[r[0]] for r in brute_repair(short)] == brute_repair(short)
    whole = {r[0]: r for r in by_key(path_repair.repair_conversations(frame(spark, rows), piece=8192).collect())}
    assert got == whole
    assert path_repair.repair_conversations(frame(spark, [])).count() == 0


def test_ranks_order_audits():
    """Ranks order the least audits of all nodes; every audit is read through the doubled pointers."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 9, 40)
    n, k = int(sizes.sum()), sizes.size
    pieces, final = path_repair.Pieces(sizes, rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.2), np.ones(k, bool)
    cost = pieces.costs(np.tile(path_repair.END, (k, 1)), final)
    label, doubled, rank, length = pieces.ranked(cost, final)

    def walk(v):
        out = ""
        while label[v]:
            out, v = out + " DIKR"[label[v]], doubled[0][v]
        return out

    audits = [walk(v) for v in range(label.size)]
    assert [len(a) for a in audits] == list(length)
    order = np.argsort(rank, kind="stable")
    assert [audits[v] for v in order] == sorted(audits)
    for state in range(4):
        got, _ = pieces.audits(cost, final, np.full(k, state))
        assert got == [audits[s * 4 + state] for s in pieces.slots]
