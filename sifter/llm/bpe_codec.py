"""Operator 8: byte-pair encoding and decoding by a pair occurrence index.

Each task gathers the distinct new words of a chunk of whole texts, lays their
symbols out in one linked array and keeps an index from every mergeable pair to
all its positions in the chunk.  The active ranks are applied in ascending order:
all positions of the pair are joined at once, and the lists of the pairs that
arise left and right of them are extended.  A pair that contains a merged symbol
always ranks after the merge that made the symbol, so one ascending pass is the
same as merging each word by itself.  Encoded words stay in a bounded cache of
the worker; only distinct words are ever merged.

Defined cases: null or empty text encodes to no ids and decodes to ''; special
token strings inside a text become their id, as the library does by default;
repeated rows give repeated rows; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import kept, load_tokenizer, tokenizer_path
from sifter.llm.token_counts import SPACE

#: Words and chunks that a worker remembers, and the longest such chunk.
CACHE = 150_000
LONGEST = 64

#: Fixed value: the word pattern of the vocabulary (matches are kept, the rest is dropped).
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """Printable stand-in of every byte: printable Latin-1 stands for itself, the others
    take the code points from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


#: Punctuation that stands alone as a word behind letters (not the apostrophe, which may open a suffix).
MARKS = frozenset(".,;:!?")


class WordSplitter:
    """Words of a text as the library finds them; special strings stand apart.

    No word spans white space, and neither normalisation nor a special string crosses it, so a text is first cut
    there into chunks, each of which has its words whatever stands around it.  Characters below U+0250 have had the
    same case, category and (no) composition in all versions of Unicode, so a chunk of these is split here; every
    other one by the library's own normaliser and pre-tokeniser, whose tables are its own."""

    def __init__(self, tok):
        import regex

        self.tok = tok
        self.find = regex.compile(WORDS).findall
        self.old = re.compile("[\0-\u024f]*").fullmatch
        self.space = regex.compile(f"[^{SPACE}]+").findall
        self.byte = {c: b for b, c in enumerate(byte_alphabet())}
        specials = [t.content for t in tok.get_added_tokens_decoder().values()]
        if any(regex.search(f"[{SPACE}]", s) for s in specials):
            raise ValueError("a special string with white space in it")
        self.specials = frozenset(specials)
        self.mark = os.path.commonprefix(specials)      # no special string where this is not
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def may_be_special(self, text: str) -> bool:
        return self.cut is not None and self.mark in text and self.cut.search(text) is not None

    def chunks(self, text: str | None) -> tuple[list[str], bool]:
        """``text`` cut at white space (str.split also cuts at U+001C to U+001F, which the library does not); True if
        it is of old characters only and no special string is in it: then its chunks are in lower case."""
        if not text:
            return [], True
        old = self.old(text) is not None
        if old:
            low = text.lower()
            old = not (self.mark and self.mark in low)
            text = low if old else text
        return (self.space(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()), old

    def new_words(self, cut: list[tuple[list[str], bool]], known: dict) -> tuple[set[str], dict[str, list[str]]]:
        """Of all chunks of ``cut`` that are not known: those that are one word themselves, and the words of the others."""
        def unknown(of_old: bool) -> set[str]:
            return set(filterfalse(known.__contains__, chain.from_iterable([c for c, old in cut if old == of_old])))

        plain = unknown(True)
        words = set(filter(str.isalpha, plain))
        parts = {c: self.word_and_mark(c) or self.plain(c) for c in plain - words}
        parts.update((c, self.words(c)) for c in unknown(False).difference(words, parts))
        return words, parts

    def plain(self, chunk: str) -> list[str]:
        if self.old(chunk):
            low = chunk.lower()
            return [low] if low.isalpha() else self.find(low)
        found = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte.__getitem__, p)).decode("utf-8") for p, _ in found]

    def words(self, chunk: str) -> list[str]:
        if not self.may_be_special(chunk):
            return self.plain(chunk)
        return [w for p in self.cut.split(chunk) for w in ([p] if p in self.specials else self.plain(p) if p else [])]

    @staticmethod
    def word_and_mark(chunk: str) -> list[str] | None:
        """A word of letters (old ones, in lower case) and the one punctuation mark behind it: two words of the library."""
        return [chunk[:-1], chunk[-1]] if chunk[-1] in MARKS and chunk[:-1].isalpha() else None


def remembered(known: dict, used, limit: int) -> dict:
    """``known``, or what of it is used now where it holds more than ``limit`` entries."""
    return known if len(known) <= limit else {k: known[k] for k in known.keys() & set(used)}


class PairIndexBpe:
    """Merge table of a vocabulary file and the pair-index encoder over many words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        letters = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (self.left << 32) | self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair (a, b), -1 where it never merges."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in word order, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = data.size
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ends = np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        nxt = np.arange(1, n + 1)
        nxt[ends] = -1
        prv = np.arange(-1, n - 1)
        prv[ends[:-1] + 1] = -1
        prv[0] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not at.size:
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        add(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            at = at[alive[at] & (sym[at] == self.left[r])]
            after = nxt[at]
            ok = after >= 0
            ok[ok] = sym[after[ok]] == self.right[r]
            at, after = at[ok], after[ok]
            if self.left[r] == self.right[r] and at.size > 1:
                # runs of one symbol: every second position from the left
                chained = np.concatenate([[False], after[:-1] == at[1:]])
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(at.size)))
                take = (np.arange(at.size) - start) % 2 == 0
                at, after = at[take], after[take]
            if not at.size:
                continue
            beyond = nxt[after]
            sym[at] = self.made[r]
            alive[after] = False
            nxt[at] = beyond
            has = beyond >= 0
            prv[beyond[has]] = at[has]
            before = prv[at]
            add(np.concatenate([before[before >= 0], at[has]]))
        kept = np.add.reduceat(alive.astype(np.int64), np.concatenate([[0], ends[:-1] + 1])) if sizes.all() else None
        if kept is None:
            c = np.concatenate([[0], np.cumsum(alive)])
            kept = c[ends + 1] - c[ends + 1 - sizes]
        return sym[alive], kept


class Codec:
    """Encodes and decodes texts; words and whole chunks are remembered as (number of ids, ids as text, decoded text)."""

    def __init__(self, path: str):
        self.bpe = PairIndexBpe(path)
        self.split = WordSplitter(load_tokenizer(path))
        self.names = [str(i) for i in range(len(self.bpe.token))]
        self.words: dict[str, tuple[int, str, str]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def learn_words(self, used: set[str]) -> None:
        self.words = remembered(self.words, used, CACHE)
        new = list(used.difference(self.words))
        for s in self.bpe.special.keys() & set(new):
            self.words[s] = (1, self.names[self.bpe.special[s]], s)
        new = [w for w in new if w not in self.bpe.special]
        ids, counts = self.bpe.encode(new)
        ids, at = ids.tolist(), 0
        for w, n in zip(new, counts.tolist()):
            own = ids[at:at + n]
            at += n
            self.words[w] = (n, " ".join([self.names[i] for i in own]), " ".join([self.bpe.token[i] for i in own]))

    def run(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, ids as text and decoded text of each text."""
        cut = [self.split.chunks(t) for t in texts]
        self.known = known = remembered(self.known, (c for own, _ in cut for c in own), CACHE)
        single, parts = self.split.new_words(cut, known)
        self.learn_words(single.union(*parts.values()))
        known.update([(w, self.words[w]) for w in single])
        for c, words in parts.items():
            n, i, d = zip(*[self.words[w] for w in words])
            known[c] = sum(n), " ".join(i), " ".join(d)
        counts, ids, decoded = [], [], []
        for own, _ in cut:
            n, i, d = zip(*map(known.__getitem__, own)) if own else ((), (), ())
            counts.append(sum(n))
            ids.append(" ".join(i))
            decoded.append(" ".join(d))
        for c in [c for c in (*single, *parts) if len(c) > LONGEST]:
            del known[c]
        return counts, ids, decoded


def codec(name: str) -> Codec:
    path = name if os.path.sep in name else tokenizer_path(name)
    return kept(("codec", path), lambda: Codec(path))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, name: str = "word_bpe_49k.json", with_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; ``with_text`` adds
    the ids (as text) and the decoded text themselves."""

    def run(batches):
        for b in batches:
            counts, ids, decoded = codec(name).run(b.column(1).to_pylist())
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array([_sha(i) for i in ids], pa.string()),
                    pa.array([_sha(d) for d in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
