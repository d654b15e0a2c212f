"""Operator 5: benchmark decontamination by q-gram lemma filtering.

A benchmark item is cut into overlapping windows of ``WINDOW`` characters, each
with an edit budget.  A window that occurs in a text with at most ``k`` edits
shares at least ``length + 1 - q * (k + 1)`` character q-grams with it, all near
one diagonal.  Texts are reduced to the regions that hold enough benchmark
q-grams; there the shared q-grams are counted in overlapping diagonal bands, and
bands that reach the bound are verified by banded alignment (edit distance with
free ends in the text).

The benchmark is the stated query set: it is taken in blocks of at most
about ``BLOCK_CHARS`` characters, one block at a time is sent to the tasks, and every
document is held against every block.  Documents do not move.

Items shorter than ``MIN_CHARS`` have too few q-grams for the lemma; their edit
budget is 0 and they are looked for as they are, between ends of words, all of them in
one pass over a text (an automaton).

Defined cases: texts and items are lower-cased and their white space is made one
space; null and empty texts and items match nothing; a very long text is searched in
its portion alone; repeated rows give repeated rows; equal items are all
reported; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import in_portions, release

Q = 10
WINDOW, STRIDE = 96, 48
#: Edits allowed in a whole window (in proportion for shorter items).
EDITS = 6
MIN_CHARS = 32
BLOCK_CHARS = 1 << 21
#: Characters that are searched at once (about a hundred bytes of memory each).
PORTION = 1 << 20
BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Stands between texts; no character has this code.
GAP = 0xFFFFFFFF


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at every position, by doubling lengths."""
    if c.size < q:
        return np.zeros(0, np.uint64)
    power, length, bit, done, out = BASE, 1, 1, 0, None
    h = c.astype(np.uint64) + np.uint64(1)
    while True:
        if q & bit:
            if out is None:
                out, done = h, length
            else:
                n = c.size - done - length + 1
                out = out[:n] * _pow(length) + h[done:done + n]
                done += length
        if done == q:
            break
        n = c.size - 2 * length + 1
        h = h[:n] * power + h[length:length + n]
        power, length, bit = _pow(2 * length), 2 * length, bit * 2
    return out[:c.size - q + 1] * np.uint64(0xFF51AFD7ED558CCD)


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


class Block:
    """q-gram index over the windows of some benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, stride: int = STRIDE, edits: int = EDITS, q: int = Q):
        self.items = [i for i, _ in items]
        windows, owner, self.short = [], [], {}
        for n, (_, text) in enumerate(items):
            c = codes(normal(text))
            if c.size < MIN_CHARS:
                if c.size:
                    self.short.setdefault(normal(text), []).append(n)
                continue
            w = min(window, c.size)
            for a in sorted({*range(0, c.size - w + 1, stride), c.size - w}):
                windows.append(c[a:a + w])
                owner.append(n)
        self.windows, self.owner = windows, np.array(owner, np.int64)
        self.length = np.array([w.size for w in windows], np.int64)
        self.edits = self.length * edits // window
        self.bound = self.length + 1 - q * (self.edits + 1)
        self.per_item = np.bincount(self.owner, minlength=len(items)) if windows else np.zeros(len(items), np.int64)
        self.per_item[[n for own in self.short.values() for n in own]] = 1
        h = [gram_hashes(w, q) for w in windows]
        hashes = np.concatenate(h) if h else np.zeros(0, np.uint64)
        by = np.argsort(hashes, kind="stable")
        self.hashes = hashes[by]
        self.window_of = np.repeat(np.arange(len(windows)), [x.size for x in h])[by]
        self.place = np.concatenate([np.arange(x.size) for x in h])[by] if h else np.zeros(0, np.int64)
        self.member = np.zeros(1 << BITS, bool)
        self.member[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.reach = window + edits
        self.band = edits + 1

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item, matched windows, fewest edits), for items found in a text."""
        found = self._short_items(texts) if self.short else []
        if self.windows:
            found += [(a + d, i, n, e) for a, b in in_portions(texts, PORTION) for d, i, n, e in self._matches(texts[a:b])]
        return sorted(found)

    def _short_items(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """Items without an edit budget that stand in a text as whole words."""
        import ahocorasick

        find = ahocorasick.Automaton()
        for text, own in self.short.items():
            find.add_word(text, (text, own))
        find.make_automaton()
        found = set()
        for d, t in enumerate(map(normal, texts)):
            for last, (item, own) in find.iter(t):
                first = last - len(item) + 1
                # an end of the item that is no letter or digit ends a word by itself
                if (first == 0 or not (t[first - 1].isalnum() and t[first].isalnum())) and (
                        last + 1 == len(t) or not (t[last].isalnum() and t[last + 1].isalnum())):
                    found.update((d, n) for n in own)
        return [(d, n, 1, 0) for d, n in found]

    def _matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        parts, gap = [], np.full(self.reach + 2 * self.band, GAP, np.uint32)
        starts, at = [], gap.size
        for t in texts:
            c = codes(normal(t))
            starts.append(at)
            parts += [c, gap]
            at += c.size + gap.size
        text = np.concatenate([gap, *parts])
        h = gram_hashes(text)
        member = self.member[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        # regions as long as an occurrence that hold enough member q-grams
        c = np.concatenate([[0], np.cumsum(member)])
        dense = np.flatnonzero(c[self.reach:] - c[:-self.reach] >= self.bound.min())
        mark = np.zeros(h.size + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, np.minimum(dense + self.reach, h.size), -1)
        pos = np.flatnonzero(member & (np.cumsum(mark[:-1]) > 0))
        lo = np.searchsorted(self.hashes, h[pos], "left")
        n = np.searchsorted(self.hashes, h[pos], "right") - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        if not pos.size:
            return []
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, place = self.window_of[entry], self.place[entry]
        diagonal = np.repeat(pos, n) - place + gap.size
        width = 2 * self.band
        span = 2 * (text.size // width + gap.size + 2)
        found = []
        for shift in (0, 1):
            key = window * span + 2 * ((diagonal + shift * self.band) // width) + shift
            shared = np.unique(key * WINDOW + place) // WINDOW
            keys, count = np.unique(shared, return_counts=True)
            found.append(keys[count >= self.bound[keys // span]])
        found = np.concatenate(found)
        window, rest = found // span, found % span
        first = rest // 2 * width - (rest % 2) * self.band - gap.size
        edits = self._aligned(text, window, first)
        ok = edits <= self.edits[window]
        window, first, edits = window[ok], first[ok], edits[ok]
        middle = first + self.band + self.length[window] // 2
        doc = np.searchsorted(np.array(starts), middle, "right") - 1
        out: dict[tuple[int, int], tuple[set, int]] = {}
        for d, w, e in zip(np.maximum(doc, 0).tolist(), window.tolist(), edits.tolist()):
            seen, least = out.get((d, int(self.owner[w])), (set(), 1 << 30))
            out[d, int(self.owner[w])] = (seen | {w}, min(least, e))
        return [(d, i, len(seen), least) for (d, i), (seen, least) in sorted(out.items())]

    def _aligned(self, text: np.ndarray, window: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Least edits of each window within its band, free at both ends in the text."""
        out = np.full(window.size, 1 << 30)
        for length in np.unique(self.length[window]) if window.size else ():
            rows = np.flatnonzero(self.length[window] == length)
            for a in range(0, rows.size, 20_000):
                part = rows[a:a + 20_000]
                out[part] = self._align(text, np.stack([self.windows[w] for w in window[part].tolist()]), first[part])
        return out

    def _align(self, text: np.ndarray, pattern: np.ndarray, first: np.ndarray) -> np.ndarray:
        k = self.band
        wide = 4 * k
        at = np.clip(first[:, None] - k + np.arange(pattern.shape[1] + wide), 0, text.size - 1)
        region = text[at]
        steps = np.arange(wide, dtype=np.int32)
        d = np.zeros((first.size, wide), np.int32)
        for i in range(pattern.shape[1]):
            new = d + (region[:, i:i + wide] != pattern[:, i:i + 1])
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(new - steps, axis=1) + steps
        return d.min(axis=1)


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Blocks of the benchmark one after the other, each small enough to send to every task."""
    total = benchmark.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_chars))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for i in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Block(sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, edits): the items found in each document, the share of
    an item's windows that was found, and the fewest edits of a window."""
    sc, out = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in benchmark_blocks(benchmark, block_chars):
        found = rows.mapInArrow(_finder(sc.broadcast(block)), "doc_id long, item_id long, n_windows int, coverage double, edits int")
        out = found if out is None else out.unionAll(found)
    return out


def _finder(shared):
    def run(batches):
        release()
        block = shared.value
        for b in batches:
            found = block.matches(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([d for d, *_ in found], pa.int64())),
                 pa.array([block.items[i] for _, i, *_ in found], pa.int64()),
                 pa.array([n for _, _, n, _ in found], pa.int32()),
                 pa.array([n / int(block.per_item[i]) for _, i, n, _ in found], pa.float64()),
                 pa.array([e for *_, e in found], pa.int32())], ["doc_id", "item_id", "n_windows", "coverage", "edits"])
    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    for block in benchmark_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_cleaner(sc.broadcast(block), at), docs.schema)
    return docs


def _cleaner(shared, at: int):
    def run(batches):
        release()
        for b in batches:
            dirty = {d for d, *_ in shared.value.matches(b.column(at).to_pylist())}
            yield b.filter(pa.array([i not in dirty for i in range(b.num_rows)], pa.bool_()))
    return run
