"""Tensored MinHash against comparing every pair."""

import random

import pytest

from sifter.llm import minhash_tensor as M
from sifter.llm.common import prepare
from tests.llm.helpers import brute_components, edge_docs, edge_rows, empty_docs


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def _check(spark, docs, shingle):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle).collect()}
    expect = {d: (n, c, c == d) for d, (n, c) in brute_components(docs, shingle).items()}
    assert got == expect


def test_groups_hubs_and_chains(spark):
    """Exact copies, near copies, a hub whose copies are linked through it only, a chain, and short texts."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = []

    def change(words, share):
        out = list(words)
        for i in rng.sample(range(len(out)), int(share * len(out))):
            out[i] = rng.choice(vocabulary)
        return out

    for _ in range(150):
        docs.append(text(rng.randint(30, 200)))
    docs += [docs[0]] * 40                                             # exact copies
    docs += [change(docs[1], 0.02) for _ in range(40)]                 # near copies
    hub = text(300)
    docs += [hub] + [change(hub, 0.05) for _ in range(60)]             # linked to the hub, hardly to each other
    link = text(200)
    for _ in range(25):                                                # a chain of small steps
        docs.append(link)
        link = change(link, 0.04)
    docs += [["a"], ["a"], ["a", "b"], [], ["b"]]
    rng.shuffle(docs)
    _check(spark, [(i * 3 + 1, " ".join(w)) for i, w in enumerate(docs)], 2)


def test_copies_among_lookalikes(spark):
    """Near copies with large ids inside a large set of pages of one stock of words, about 0.35 alike: smaller ids own their entries."""
    rng = random.Random(5)
    stock = [f"f{i}" for i in range(400)]
    docs = [rng.sample(stock, 208) for _ in range(4000)]
    for _ in range(150):
        one = rng.sample(stock, 208)
        docs += [one, [*one[:-14], *(f"p{rng.randrange(10**9)}" for _ in range(14))]]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 1).collect()}
    assert got == {i: i if i < 4000 else i - i % 2 for i in range(len(docs))}


def test_blocks_of_an_entry(spark, monkeypatch):
    """The same where the members of an entry are dealt into several blocks."""
    monkeypatch.setattr(M, "ENTRY_BLOCK", 100)
    test_copies_among_lookalikes(spark)


def test_edges_and_five_words(spark):
    rows = {d: t for d, t, *_ in edge_rows() if d is not None}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(edge_docs(spark), 5).collect()}
    assert got == brute_components(list(rows.items()), 5)
    assert M.near_duplicates(empty_docs(spark)).count() == 0
    kept = M.keep_one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 2 and 11 not in ids and {1, 2, 3, 6, 9} <= set(ids)


def test_synthetic_corpus(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    _check(spark, docs, 2)


def test_component_labels(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [
        (rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "a long, b long")
    for one_task in (1_000_000, 10):                 # in one task, and by distributed rounds
        got = {r.id: r.label for r in M.components(links, one_task).collect()}
        assert got == {x: find(x) for x in list(parent)}
    assert M.components(links.where("false")).count() == 0
