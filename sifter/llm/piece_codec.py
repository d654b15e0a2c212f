"""Operator 12: SentencePiece encoding and decoding that keeps the place of every piece in the original text.

A text is normalised from left to right: at each place the longest entry of the
model's compiled character map (a double-array trie over UTF-8 bytes) is replaced
by its normal form, any other character stays, spaces become the mark U+2581, and
every normalised byte records the original byte at which its source starts.  The
normal form is segmented by the model's pair scores (best score first, leftmost
of equals); a character outside the vocabulary falls back to its bytes.  The
boundaries of the pieces are then looked up in the recorded alignment, which gives
the span of original bytes of each piece: the spans follow each other and cover
the text.

No piece of such a vocabulary has the mark behind another character, so no merge
crosses the start of a run of marks; the words between are segmented once and
remembered by the worker (a bounded cache).  A vocabulary that has such a piece is
segmented text by text.

Defined cases: null or empty text has the end id alone and decodes to ''; the mark
itself in a text decodes to a space, as in the library; strings that look like
control pieces are ordinary text; a very long text is processed whole, alone in its
portion; repeated rows give repeated rows; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import in_portions, kept, tokenizer_path

MARK = "▁"
#: Words that a worker remembers, and the longest such word (longer ones are segmented by themselves); characters that are
#: processed together.
CACHE = 300_000
LONGEST = 64
PORTION = 1_000_000


# ---------------------------------------------------------------- model file (protocol buffer wire format)

def fields(data: bytes):
    """(number, value) of every field of a serialized message: int, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class Model:
    """What the codec needs of a model file.  FIXED VALUES: field numbers and piece kinds of the public format."""

    UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        self.piece, self.score, self.kind = [], [], []
        trainer: dict = {}
        normal: dict = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.piece.append(own.get(1, b"").decode("utf-8"))
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, 1))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        self.is_bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_mark = bool(trainer.get(24, 0))
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.char_map = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.trim = bool(normal.get(4, 1))
        self.escape = bool(normal.get(5, 1))
        self.unk = self.kind.index(self.UNKNOWN) if self.UNKNOWN in self.kind else 0
        self.end = self.piece.index("</s>") if "</s>" in self.piece else None


# ---------------------------------------------------------------- normalisation with alignment

class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double array of 32-bit units and the normal forms."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.forms = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Normal form and length of the longest entry that ``data`` has at ``at``."""
        found, node, i = None, self._offset(self.units[0]), at
        while i < len(data):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            i += 1
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, i - at
        if found is None:
            return None
        return self.forms[found[0]:self.forms.index(b"\0", found[0])], found[1]


class Normaliser:
    def __init__(self, model: Model):
        self.model, self.map = model, CharacterMap(model.char_map) if model.char_map else None
        self.space = MARK if model.escape else " "
        #: the alignment follows from the marks alone: each stands for one space, the first for nothing
        self.plain = self.map is None and not model.trim and model.dummy_prefix and model.escape and not model.suffix_mark

    def run(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normal form, and for each of its bytes (and its end) the original byte where its source starts;
        None instead where each mark stands for one space and the first for nothing."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.plain and MARK not in text:
            return MARK + text.replace(" ", MARK), None
        return self.aligned(text)

    def _next(self, data: bytes, at: int) -> tuple[bytes, int]:
        if self.map is not None and (hit := self.map.longest(data, at)):
            return hit
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + n], n

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        m, data, at = self.model, text.encode("utf-8"), 0
        space, out, source = self.space.encode(), bytearray(), []
        if m.trim:
            while at < len(data) and (hit := self._next(data, at))[0] == b" ":
                at += hit[1]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        if m.dummy_prefix and not m.suffix_mark:
            out += space
            source += [at] * len(space)
        after_space = m.trim
        while at < len(data):
            form, n = self._next(data, at)
            while after_space and form.startswith(b" "):
                form = form[1:]
            if form:
                shown = form.replace(b" ", space)
                out += shown
                source += [at] * len(shown)
                after_space = form.endswith(b" ")
            at += n
            if not m.trim:
                after_space = False
        if m.trim:
            while out.endswith(space):
                del out[-len(space):]
                at = source[-len(space)]
                del source[-len(space):]
        if m.dummy_prefix and m.suffix_mark:
            out += space
            source += [at] * len(space)
        return out.decode("utf-8"), np.array([*source, at], np.int64)


# ---------------------------------------------------------------- segmentation

class Joins:
    """For two neighbouring symbols: the rank of the piece that they form (equal scores, equal ranks) and its symbol; a hash
    table with linear probing that looks up whole arrays.  Symbols of pieces are their ids, then come single characters that
    only occur inside pieces."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, score: dict[str, float], ids: dict[str, int], size: int):
        symbol = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbol[c] = size + len(symbol) - len(ids)
        self.symbols = size + len(symbol) - len(ids)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = {v: k for k, v in enumerate(sorted(set(score.values())))}
        keys, ranks, made = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                if (x := symbol.get(p[:cut])) is not None and (y := symbol.get(p[cut:])) is not None:
                    keys.append(x * self.symbols + y)
                    ranks.append(order[score[p]])
                    made.append(i)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.rank, self.made = np.full(self.keys.size, self.NONE), np.zeros(self.keys.size, np.int32)
        keys, ranks, made = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32)
        at, self.probes = self.slot(keys), 0
        while keys.size:
            self.probes += 1
            free = self.keys[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(at.size)), return_index=True)
            put = one[free[one]]
            self.keys[at[put]], self.rank[at[put]], self.made[at[put]] = keys[put], ranks[put], made[put]
            rest = np.ones(at.size, bool)
            rest[put] = False
            keys, ranks, made, at = keys[rest], ranks[rest], made[rest], at[rest] + 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they form no piece) and symbol of the joined pairs."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.symbols + b)
        at = self.slot(np.maximum(key, 0))
        rank, made = np.full(key.shape, self.NONE), np.zeros(key.shape, np.int32)
        for _ in range(self.probes):
            hit = self.keys[at] == key
            rank[hit], made[hit] = self.rank[at[hit]], self.made[at[hit]]
            at = at + 1
        return rank, made


class PieceCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.setup(Model(f.read()))

    def setup(self, model: Model) -> None:
        if not model.is_bpe or {model.USER_DEFINED, model.UNUSED} & set(model.kind):
            raise ValueError("a pair-merging model without user-defined and unused pieces is needed")
        self.model, self.normal = model, Normaliser(model)
        self.id = {p: i for i, (p, k) in enumerate(zip(model.piece, model.kind)) if k == 1}
        self.score = {p: -model.score[i] for p, i in self.id.items()}
        self.byte_id = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(model.piece, model.kind)) if k == model.BYTE}
        self.joins = Joins(self.score, self.id, len(model.piece))
        self.names = [str(i) for i in range(len(model.piece))]
        self.surface = [p.replace(MARK, " ") if k == 1 else "" for p, k in zip(model.piece, model.kind)]
        #: original bytes of a piece where a mark is one space
        self.bytes = [len(s.encode("utf-8")) for s in self.surface]
        inside = any(MARK in p.lstrip(MARK) for p in self.id)
        self.words = (lambda t: [t]) if inside else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, tuple[str, str, bytes]] = {}

    def segment(self, word: str) -> list[int]:
        """Symbols of one long word (see ``segments``), with a queue of the neighbours that form a piece."""
        sym = list(word)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, score = [], self.score
        for i in range(n - 1):
            if (s := score.get(sym[i] + sym[i + 1])) is not None:
                queue.append((s, i, i + 1, 2))
        heapq.heapify(queue)
        while queue:
            _, a, b, size = heapq.heappop(queue)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a] += sym[b]
            sym[b] = ""
            nxt[a] = c = nxt[b]
            if c < n:
                prv[c] = a
                joined = sym[a] + sym[c]
                if (s := score.get(joined)) is not None:
                    heapq.heappush(queue, (s, a, c, len(joined)))
            if (p := prv[a]) >= 0:
                joined = sym[p] + sym[a]
                if (s := score.get(joined)) is not None:
                    heapq.heappush(queue, (s, p, a, len(joined)))
        return [self.id.get(s, -2 - ord(s[0])) for s in sym if s]

    def segments(self, words: list[str]) -> list[list[int]]:
        """Symbols of every word: of all neighbours that form a piece the best-scored pair is joined first, the leftmost of
        equals; -2 - c for a character c that is no piece.  Short words are laid out in one table and joined step by step
        together, one pair of each word at a time."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(lengths > LONGEST).tolist():
            out[i] = self.segment(words[i])
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 32), (32, LONGEST)):
            mine = np.flatnonzero((lengths > low) & (lengths <= high))
            if not mine.size:
                continue
            points = np.frombuffer("".join([words[i] for i in mine.tolist()]).encode("utf-32-le"), "<u4").astype(np.int32)
            sym = np.full((mine.size, high), -1, np.int32)
            piece = self.joins.char[points]
            sym[np.arange(high) < lengths[mine][:, None]] = np.where(piece >= 0, piece, -2 - points)
            self._join(sym, mine, out)
        return out

    def _join(self, sym: np.ndarray, mine: np.ndarray, out: list) -> None:
        size = len(self.model.piece)
        rank = self.joins.find(sym[:, :-1], sym[:, 1:])[0]
        while True:
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rank), np.int64)
            more = rank[np.arange(len(rank)), best] < Joins.NONE if rank.shape[1] else np.zeros(len(rank), bool)
            for i, row in zip(mine[~more].tolist(), sym[~more].tolist()):
                out[i] = [s if s < size else -2 - ord(self._alone(s)) for s in row if s != -1]
            if not more.any():
                return
            mine, sym, rank, best = mine[more], sym[more], rank[more], best[more]
            rows, col = np.arange(len(mine)), np.arange(sym.shape[1] - 1)
            joined = self.joins.find(sym[rows, best], sym[rows, best + 1])[1]
            sym = np.where(col <= best[:, None], sym[:, :-1], sym[:, 1:])
            sym[rows, best] = joined
            rank = np.where(col[:-1] < best[:, None], rank[:, :-1], rank[:, 1:])
            for at in (best - 1, best):
                on = (at >= 0) & (at < rank.shape[1])
                rank[rows[on], at[on]] = self.joins.find(sym[rows[on], at[on]], sym[rows[on], at[on] + 1])[0]

    def _alone(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.joins.char == symbol)[0]))

    def ids_of(self, symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ids of a word's symbols, the normalised bytes of each, and its original bytes where a mark is one space; of a
        character that falls back to bytes the last one stands for the whole."""
        ids, sizes, own, m = [], [], [], self.model
        for s in symbols:
            if s >= 0:
                ids.append(s)
                sizes.append(len(m.piece[s].encode("utf-8")))
                own.append(self.bytes[s])
                continue
            c = chr(-2 - s)
            raw, n = c.encode("utf-8"), 1 if c == MARK else len(c.encode("utf-8"))
            if m.byte_fallback:
                ids += [self.byte_id[b] for b in raw]
                sizes += [1] * len(raw)
                own += [0] * (len(raw) - 1) + [n]
            elif ids and ids[-1] == m.unk:
                sizes[-1] += len(raw)
                own[-1] += n
            else:
                ids.append(m.unk)
                sizes.append(len(raw))
                own.append(n)
        return ids, sizes, own

    def learn(self, used: set[str]) -> dict[str, tuple[str, str, bytes]]:
        """Word -> (ids as text, decoded text, original bytes of each id where a mark is one space) of all used words and
        of those that are remembered."""
        if len(self.known) > CACHE:
            self.known = {w: self.known[w] for w in used & self.known.keys()}
        new, names, surface, size = list(used.difference(self.known)), self.names, self.surface, self.bytes
        long = {}
        for w, symbols in zip(new, self.segments(new)):
            if min(symbols) >= 0:
                row = " ".join([names[i] for i in symbols]), "".join([surface[i] for i in symbols]), [size[i] for i in symbols]
            else:
                ids, _, own = self.ids_of(symbols)
                row = " ".join([names[i] for i in ids]), self.pieces_text(ids), own
            (self.known if len(w) <= LONGEST else long)[w] = row[0], row[1], array("I", row[2]).tobytes()
        return self.known | long if long else self.known

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids, bytes put together, marks as spaces; nothing is cut at the start."""
        m, out, raw = self.model, [], bytearray()
        for i in ids:
            if m.kind[i] == m.BYTE:
                raw.append(int(m.piece[i][1:-1], 16))
                continue
            if raw:
                out.append(as_text(bytes(raw)))
                raw.clear()
            if m.kind[i] != m.CONTROL:
                out.append(m.unk_surface if i == m.unk else m.piece[i].replace(MARK, " "))
        if raw:
            out.append(as_text(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: the mark that the prefix put in front is taken off."""
        m = self.model
        first = next((i for i, x in enumerate(ids) if m.kind[x] != m.CONTROL), len(ids))
        text = self.pieces_text(ids[first:])
        if (m.dummy_prefix or m.trim) and first < len(ids) and m.piece[ids[first]].startswith(MARK):
            return text.lstrip(" ") if m.trim else text[1:]
        return text

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str, np.ndarray, np.ndarray]]:
        """(number of ids, ids as text, decoded text, first byte, end byte of each id) of every text; no end ids."""
        normal = [self.normal.run(t or "") for t in texts]
        words = [self.words(n) for n, _ in normal]
        known = self.learn(set().union(*words))
        return [self._text(w, source, known) for w, (_, source) in zip(words, normal)]

    def _text(self, words: list[str], source: np.ndarray | None, known: dict) -> tuple[int, str, str, np.ndarray, np.ndarray]:
        ids, decoded, sizes = zip(*map(known.__getitem__, words)) if words else ((), (), ())
        if source is None:
            # the prefix stands for nothing: all ends lie one byte earlier, the text starts at 0
            ends = np.maximum(np.cumsum(np.frombuffer(b"".join(sizes), np.uint32), dtype=np.int64) - 1, 0)
            begins = np.concatenate([[0], ends[:-1]])
        else:
            cuts = np.cumsum([0, *[n for symbols in self.segments(words) for n in self.ids_of(symbols)[1]]])
            begins, ends = source[cuts[:-1]], source[cuts[1:]]
        decoded = "".join(decoded)
        if words and (self.model.dummy_prefix or self.model.trim) and decoded.startswith(" "):
            decoded = decoded.lstrip(" ") if self.model.trim else decoded[1:]
        return ends.size, " ".join(ids), decoded, begins, ends


def as_text(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return raw[:e.start].decode("utf-8") + "�" + as_text(raw[e.start + 1:])


def codec(name: str) -> PieceCodec:
    path = name if os.path.sep in name else tokenizer_path(name)
    return kept(("pieces", path), lambda: PieceCodec(path))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def encode_pieces(docs: DataFrame, name: str = "piece_bpe_32k.model", with_spans: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of every row, the end id counted; spans_crc32 is the
    crc32 of the (first byte, end byte) pairs of all pieces before the end id as little-endian unsigned 64-bit numbers.
    ``with_spans`` adds the ids, the spans (``begins``, ``ends``) and the decoded text themselves."""

    def run(batches):
        for b in batches:
            ids_col, texts = b.column(0), b.column(1)
            for a, z in in_portions(texts.to_pylist(), PORTION) if b.num_rows else []:
                lib, rows = codec(name), []
                for n, ids, decoded, begins, ends in lib.run(texts.slice(a, z - a).to_pylist()):
                    ids = f"{ids} {lib.model.end}" if ids else str(lib.model.end)
                    row = [n + 1, _sha(ids), _sha(decoded), zlib.crc32(np.stack([begins, ends], 1).astype("<u8"))]
                    rows.append(row + ([list(map(int, ids.split())), begins, ends, decoded] if with_spans else []))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
                if with_spans:
                    kinds += [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                    names += ["ids", "begins", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays([ids_col.slice(a, z - a), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    schema = DIGESTS + ", ids array<int>, begins array<long>, ends array<long>, decoded string" * with_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids): any ids of the model, null ids decode to ''."""

    def run(batches):
        for b in batches:
            lib = codec(name)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([lib.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id long, decoded string")
