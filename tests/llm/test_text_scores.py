"""Fingerprints, language model, language ID, license scans against brute force."""

import collections
import hashlib
import math
import re

import pytest
import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.llm import backoff_lm, langid, license_join, spotsigs
from sifter.llm.common import held_out, prepare
from tests.llm.helpers import crc, edge_docs, edge_rows, empty_docs, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def test_spotsigs_edges(spark):
    rows = spotsigs.fingerprints(edge_docs(spark)).collect()
    texts = collections.defaultdict(list)
    for d, t, *_ in edge_rows():
        texts[d].append(t or "")
    assert collections.Counter(r.doc_id for r in rows) == {d: len(t) for d, t in texts.items()}
    order = [*sorted((d for d in texts if d is not None), reverse=True), None]
    by_text = collections.defaultdict(set)
    for r in rows:
        own = [t for t in texts[r.doc_id] if len(t) == r.n_chars]
        after = min(texts[order[(order.index(r.doc_id) + 1) % len(order)]])
        edited = {hashlib.sha256((t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode()).hexdigest() for t in own}
        assert r.edited_sha256 in edited
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
        for t in own:
            by_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert next(r for r in rows if r.doc_id == 2).fingerprint == "[]"
    assert spotsigs.fingerprints(empty_docs(spark)).count() == 0


def test_spotsigs_signatures_by_hand(spark):
    df = spark.createDataFrame([("The red fox and the lazy dog of old",)], "text string")
    got = spotsigs.with_signatures(df, "text", "s").first()["s"]
    chains = [("the", "red", "fox"), ("the", "lazy", "dog")]
    expect = spark.createDataFrame(chains, "a string, b string, c string").select(F.hash("a", "b", "c").alias("h")).collect()
    assert got == sorted(r.h for r in expect)
    pair = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5], [], [9])], "a array<int>, b array<int>, e array<int>, d array<int>")
    r = pair.select(spotsigs.likeness("a", "b").alias("x"), spotsigs.likeness("e", "e").alias("same"),
                    spotsigs.likeness("e", "a").alias("none"), spotsigs.likeness("a", "d", 0.5).alias("pruned")).first()
    assert (r.x, r.same, r.none, r.pruned) == (0.4, 1.0, 0.0, 0.0)


def test_spotsigs_likeness_columns(spark):
    """near_edited and near_next against sets taken anew from the returned fingerprints and from the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    edited = {d: t[:len(t) - len(t) // 2] + texts[after[d]][:len(t) // 2] for d, t in texts.items()}
    both = spark.createDataFrame([(d, "own", t) for d, t in texts.items()] + [(d, "edited", t) for d, t in edited.items()], "d long, k string, text string")
    sets = {(r.d, r.k): set(r.s) for r in spotsigs.with_signatures(both, "text", "s").collect()}

    def jaccard(x, y):
        return 1.0 if x == y else len(x & y) / len(x | y)

    for r in spotsigs.fingerprints(docs).collect():
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        assert math.isclose(r.near_edited, jaccard(sets[r.doc_id, "own"], sets[r.doc_id, "edited"]))
        assert math.isclose(r.near_next, jaccard(sets[r.doc_id, "own"], sets[after[r.doc_id], "own"]))


@pytest.mark.parametrize("order", [backoff_lm.ORDER, 2, 4])
def test_language_model_against_brute_force(spark, order):
    """Interpolated n-grams counted one by one, texts padded with start marks."""
    docs = edge_docs(spark)
    got = backoff_lm.score_texts(docs, ~held_out(F.col("doc_id"), 7, 2), order=order, block_bytes=50_000).collect()
    tokens = [(d, [*words(t), None]) for d, t, *_ in edge_rows()]
    counts, n_docs = collections.Counter(), 0
    for d, x in tokens:
        if d is None or crc(d) % 7 != 2:
            n_docs += 1
            padded = [0] * (order - 1) + x
            counts.update(tuple(padded[i - k:i + 1]) for i in range(order - 1, len(padded)) for k in range(order))
    for k in range(order):
        counts[(0,) * k] = n_docs
    uni = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != 0}
    n, v, mu = sum(uni.values()), len(uni), backoff_lm.MU
    expect = []
    for d, x in tokens:
        padded, base, score = [0] * (order - 1) + x, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (uni.get(padded[i], 0) + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(1, order):
                context = tuple(padded[i - k:i])
                if counts[context]:
                    p = (counts[*context, padded[i]] + mu * p) / (counts[context] + mu)
            score += math.log10(p)
        expect.append((d if d is not None else -1, len(x), sum(w in uni for w in x), n, d is not None and crc(d) % 7 == 2,
                       round(base, 6), round(score, 6)))
    rows = [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.held_out,
             round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(rows) == sorted(expect)
    assert backoff_lm.score_texts(empty_docs(spark), F.lit(True), order=order).count() == 0


def test_language_model_cells():
    rng = np.random.default_rng(5)
    cut = ~np.uint64(127)
    for keys in (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) & cut), np.array([0, 1 << 7, (1 << 64) - 128], np.uint64)):
        assert np.array_equal(backoff_lm.unpack_grams(backoff_lm.pack_grams(keys)), keys)
    counts = np.array([0, 1, 254, 255, 256, 10**10])
    assert np.array_equal(backoff_lm.unpack_counts(*backoff_lm.pack_counts(counts)), counts)


def test_language_model_probabilities_sum_to_one(spark):
    """Over all known words, the end and the unknown word, after a known context."""
    vocab = ["a", "b", "c"]
    train = [(1, "a b a c"), (2, "b a"), (3, "c c a")]
    probe = [(100 + i, f"a {w}") for i, w in enumerate([*vocab, "zzz"])] + [(200, "a")]
    df = spark.createDataFrame([*train, *probe], "doc_id long, text string")
    got = {r.doc_id: r for r in backoff_lm.score_texts(df, F.col("doc_id") < 100, order=2).collect()}
    ends = {w: 0.0 for w in vocab}
    uni = collections.Counter("a b a c".split() + "b a".split() + "c c a".split() + [None] * 3)
    bi = collections.Counter(p for t in ("a b a c", "b a", "c c a") for p in zip(t.split(), [*t.split()[1:], None]))
    n, v = sum(uni.values()), len(uni)
    end = lambda w: (bi[w, None] + backoff_lm.MU * (uni[None] + 1) / (n + v + 1)) / (uni[w] + backoff_lm.MU)
    total = 0.0
    first = 10 ** got[200].score / end("a")                      # p(a | start)
    for i, w in enumerate([*vocab, "zzz"]):
        after = end(w) if w in ends else (uni[None] + 1) / (n + v + 1)
        total += 10 ** got[100 + i].score / first / after
    assert math.isclose(total + end("a"), 1.0, rel_tol=1e-9)


def test_language_id_edges_and_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trains = ~held_out(F.col("doc_id"), 4, 2)
    contents = langid.dictionaries(docs, trains)
    assert set(contents) == {"en", "de", "fr", "es"} and len({len(c) for c in contents.values()}) == 1
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.predictions(docs, contents).where(held_out(F.col("doc_id"), 4, 2)).collect()
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.9 * len(out) > 20
    edge = langid.predictions(edge_docs(spark), contents).collect()
    assert len(edge) == len(edge_rows())
    for r in edge:
        if r.doc_id in (1, 2, 3, 13):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        assert 0 <= r.score <= 1
    assert langid.predictions(empty_docs(spark), contents).count() == 0
    assert {r.lang_pred for r in langid.predictions(edge_docs(spark), {}).collect()} == {"und"}
    assert langid.dictionaries(empty_docs(spark), F.lit(True)) == {}
    kept = langid.keep_recognised(edge_docs(spark), contents)
    assert kept.columns == edge_docs(spark).columns and not {1, 2, 3, 13} & {r.doc_id for r in kept.collect()}


def test_language_id_with_a_label_of_one_short_text(spark):
    """One label with a single five-letter text leaves the other languages as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    contents = langid.dictionaries(docs.unionAll(spark.createDataFrame([(-5, "qwert", "xx")], docs.schema)), F.lit(True))
    assert list(contents)[-1] == "xx" and min(map(len, contents.values())) > 10_000
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.predictions(docs, contents).collect()
    assert sum(r.lang_pred == lang[r.doc_id] and not r.rejected for r in out) >= 0.9 * len(out) > 20


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license_scan_against_brute_force(spark):
    extra = [(50, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore. Licensed under CC BY-NC 4.0. MIT-License"),
             (51, "This work is licensed under the GNU General Public License, version 3."), (52, "All rights reserved."),
             (53, "all the rights were reserved once"), (54, "word " * 500 + "permission is hereby granted, free of charge, to any "
              "person obtaining a copy of this software and associated documentation files " + "end " * 300)]
    rows = [(d, t) for d, t, *_ in edge_rows()] + extra
    got = license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expect = []
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(i, label) for p, label in license_join.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        expect.append((d if d is not None else -1, len(w), len(hits), min(at, default=-1), max(at, default=-1),
                       ",".join(sorted({x for _, x in hits}))))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word,
                   -1 if r.last_word is None else r.last_word, r.base_labels) for r in got) == sorted(expect)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[50] == "apache-2,cc-by-nc,mit" and labels[51] == "gpl" and labels[52] == "all-rights-reserved"
    assert labels[53] == "" and labels[54] == "mit"
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_join.scan(empty_docs(spark)).count() == 0


def test_license_base_phrases_of_the_contract(spark):
    """The base phrases in full, by their text; a shorter mention is the method's label alone."""
    rows = [(1, "Released UNDER the\nMIT-License; under the mit license."), (2, "The MIT license. mit license, under the"),
            (3, "under the apache license version 2.0 and CC-BY-NC 4"), (4, "see under\tthe mit licenses"), (5, None)]
    got = {r.doc_id: tuple(r)[1:7] for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (9, 2, 1, 5, "mit", "mit"), 2: (7, 0, None, None, "", "mit"), 3: (12, 2, 2, 8, "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
                   4: (5, 0, None, None, "", ""), 5: (0, 0, None, None, "", "")}


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation "
           "files (the \"Software\"), to deal\nin the Software without restriction",
    "apache-2": "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
           "published by\nthe Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not",
}


def test_license_headers_over_lines_and_sentences(spark):
    """Standard headers as they are wrapped in files, at every place of a window."""
    rows = [(i * 1000 + n, "word " * n + text) for i, text in enumerate(WRAPPED.values()) for n in (0, 1, 39, 40, 60, 79, 200)]
    got = {r.doc_id: r.labels for r in license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: list(WRAPPED)[d // 1000] for d, _ in rows}


def test_set_similarity_join_is_exact():
    """The prefix, length and position filters lose no block that a plain comparison finds."""
    import random
    rng = random.Random(3)
    vocab = [f"w{i}".encode() for i in range(30)]
    templates = [(f"t{i}", b" ".join(rng.sample(vocab, rng.randint(3, 10))).decode()) for i in range(12)]
    frequency = {w: rng.randint(0, 50) for w in vocab}
    index = license_join.TemplateIndex(templates, frequency, 0.7)
    for _ in range(400):
        block = [rng.choice(vocab) for _ in range(rng.randint(0, 25))] + [b"other"]
        plain = sorted((label, len(set(t.encode().split()) & set(block)) / len(set(t.encode().split()))) for label, t in templates)
        assert sorted(index.search(block)) == [(x, c) for x, c in plain if c >= 0.7 - 1e-9]
