"""Operator 9: license scans by an exact set-similarity join.

Text blocks (overlapping word windows of the whole text, over line and sentence
ends) are joined with license templates where a block holds at least
``CONTAINMENT`` of a template's words.  Words are ordered by their frequency in the whole corpus,
rarest first; a block can reach the threshold only if it holds a word of the
template's prefix, is long enough, and has enough of the template left behind its
first common word (position filter).  What passes is counted exactly, and the
common words must stand close together (within ``SPAN`` times the template's
length), so that a long sentence that happens to hold them is no match.  Beside it
the base rule finds every place where a phrase's words stand consecutively.

The templates are fixed values, a few hundred words, so the corpus count of
their words and the index sent to the tasks are bounded; texts do not move.

Defined cases: null or empty text has 0 words and no label; repeated rows give
repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import LOWER, release

CONTAINMENT = 0.9
SPAN = 1.5
#: Least step of the windows, in words; a window is two steps, and no step is shorter than a template's span.
STEP = 40

# ---- fixed values: phrases of the base rule, templates of the method
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("all-rights-reserved", "all rights reserved"),
]

#: Bytes that are no part of a word (after lower-casing): everything in ASCII but letters and digits.
NO_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
SPACED = bytes.maketrans(NO_WORD, b" " * len(NO_WORD))


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LOWER) if text else b""


def words_of(low: bytes) -> list[bytes]:
    return low.translate(SPACED).split()


def template_frequencies(docs: DataFrame, templates) -> dict[bytes, int]:
    """How often each word of the templates stands in the whole corpus."""
    vocab = frozenset(w for _, t in templates for w in words_of(lowered(t)))

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(filter(vocab.__contains__, words_of(lowered(text))))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in vocab} | {bytes(r["word"]): r["n"] for r in rows}


class TemplateIndex:
    """Prefix index over the frequency-ordered words of the templates."""

    def __init__(self, templates, frequency: dict[bytes, int], containment: float):
        self.order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sets, self.prefix = [], {}
        for label, text in templates:
            own = sorted(set(words_of(lowered(text))), key=self.order.__getitem__)
            need = math.ceil(containment * len(own) - 1e-9)
            for i, w in enumerate(own[:len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.sets), i))
            self.sets.append((label, frozenset(own), need, int(SPAN * len(words_of(lowered(text))))))
        self.step = max([STEP, *(span for *_, span in self.sets)])

    def search(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of every template that this block's set meets."""
        return [(self.sets[t][0], c) for t, c in self._hits(block)]

    def found(self, block: list[bytes]) -> list[tuple[str, float]]:
        """The hits of ``search`` whose words stand close together."""
        out = []
        for t, c in self._hits(block):
            label, words, need, span = self.sets[t]
            if any(len(words.intersection(block[a:a + span])) >= need for a, w in enumerate(block) if w in words):
                out.append((label, c))
        return out

    def _hits(self, block: list[bytes]) -> list[tuple[int, float]]:
        own = set(block)
        shared = sorted((w for w in own if w in self.order), key=self.order.__getitem__)
        first: dict[int, tuple[int, int]] = {}
        for j, w in enumerate(shared):
            for t, i in self.prefix.get(w, ()):
                first.setdefault(t, (i, j))
        out = []
        for t, (i, j) in first.items():
            _, words, need, _ = self.sets[t]
            if len(own) >= need and min(len(words) - i, len(shared) - j) >= need:
                common = len(words & own)
                if common >= need:
                    out.append((t, common / len(words)))
        return out


def blocks(words: list[bytes], step: int = STEP):
    """Windows of two steps over the words of a text: any ``step`` consecutive words stand in one of them."""
    for a in range(0, max(len(words) - step, 1), step):
        yield words[a:a + 2 * step]


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the places where the phrase's words stand consecutively."""
    out, at, n = [], 0, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at)
            if words[at:at + n] == phrase:
                out.append(at)
            at += 1
    except ValueError:
        return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates, template_frequencies(docs, templates), containment))
    base = [(words_of(lowered(p)), label) for p, label in phrases.items()]

    def one(text: str | None):
        words = words_of(lowered(text))
        joined = b" " + b" ".join(words) + b" "
        at, base_labels = [], set()
        for phrase, label in base:
            if b" " + b" ".join(phrase) + b" " in joined:
                at += places(words, phrase)
                base_labels.add(label)
        found: list[tuple[str, float]] = []
        if not index.value.prefix.keys().isdisjoint(words):
            found = [hit for block in blocks(words, index.value.step) for hit in index.value.found(block)]
        labels = base_labels | {label for label, _ in found}
        score = 1.0 if base_labels else max((c for _, c in found), default=0.0)
        return (len(words), len(at), min(at, default=None), max(at, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches):
        release()
        for b in batches:
            rows = list(zip(*map(one, b.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
