"""Operator 10: token ids in Arrow files of equal-length sequences.

The token stream of the corpus, documents in ascending doc_id order with the end
id after each, is cut into sequences of ``LENGTH`` ids.  Every range partition
writes one Arrow IPC stream-file into the shared folder: record batches with a
fixed-size list of ids and a fixed-size list of mask bits (false only in the
padding of a file's last sequence).  All ids of a file lie in plain, uncompressed
buffers, so any sequence, or any document by its place, is read from a memory
map without copying.  An index table (doc_id, part, place in the part, number of
ids) is written beside the files; it is spread like the documents and never
gathered.  A task writes under an attempt's name and renames at its end, so a
repeated task leaves the same file.

Defined cases: null or empty text is the end id alone; a null doc_id sorts
first; rows with equal doc_id are all written, ordered by their text; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.bpe_codec import LONGEST, MARKS, WordSplitter
from sifter.llm.common import LOWER, kept, load_tokenizer, shared_folder, stored

#: Ids of one sequence, sequences of one record batch.
LENGTH = 2048
ROWS = 256
#: Chunks of up to LONGEST bytes in each of the two generations that a worker remembers (about 200 bytes each).
CACHE = 600_000


#: Bytes of a text after the first pass: ASCII white space becomes a space, A-Z lower case.
SPACED = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
#: Kinds of bytes: an ASCII letter or digit, a mark that stands alone behind one.
ALNUM, MARK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[b for b in range(128) if chr(b).isalnum()]] = ALNUM
KIND[[ord(c) for c in MARKS]] = MARK
#: Words that the library's model gets in one call of a batch.
GROUP = 200


class LibraryWords:
    """Ids of a text as little-endian bytes: the distinct chunks of a batch, cut between white space, are encoded by the
    library once, then looked up.  Batches are cut, and their chunks numbered and replaced by ids, by array operations
    over all their bytes.  The words of a chunk are known to be whole, so the library's model gets them without its
    normaliser and word pattern."""

    def __init__(self, name: str):
        tok = load_tokenizer(name)
        self.split = WordSplitter(tok)
        self.special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.mark = self.split.mark.encode().translate(LOWER)
        self.lone = not any(s.isalpha() for s in self.special)       # letters alone are no special string
        self.marks_apart = not any(s.endswith(tuple(MARKS)) for s in self.special)
        self.model, suffix = word_model(tok)
        self.dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(tok.get_vocab().values()) + 1, bool)       # tokens at the end of a word
        self.ends[[i for t, i in tok.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def cut(self, texts: pa.Array) -> tuple[pa.Array, list[bytes], np.ndarray]:
        """The chunks of all texts: the code of each, the chunk of each code (some twice), and each text's first one.

        A chunk ends at ASCII white space; one last mark behind an ASCII letter or digit is a chunk of its own.  Only
        chunks of ASCII characters without a special string's beginning are in lower case: a capital letter may compose
        with what follows it otherwise than a small one."""
        col = pc.fill_null(texts, "").cast(pa.large_binary())
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        raw = col.buffers()[2][at[0]:at[-1]].to_pybytes().translate(SPACED) if at[-1] > at[0] else b""
        at = at - at[0]
        low = bytearray(raw.translate(LOWER))
        data, space = np.frombuffer(low, np.uint8), np.frombuffer(raw, np.uint8) == ord(" ")
        first = np.ones(len(low) + 1, bool)         # the byte before is white space or another text's
        first[1:-1] = space[:-1]
        first[at] = True
        heads = np.flatnonzero(first[:-1] & ~space)
        if not heads.size:
            return pa.array([], pa.int32()), [], np.zeros(len(at), np.int64)
        as_is = np.bitwise_or.reduceat(data, heads) >= 128
        if self.special:
            as_is[np.searchsorted(heads, list(occurrences(low, self.mark)), "right") - 1] = True
        if as_is.any():
            capital = np.flatnonzero(data != np.frombuffer(raw, np.uint8))
            capital = capital[as_is[np.searchsorted(heads, capital, "right") - 1]]
            data[capital] = np.frombuffer(raw, np.uint8)[capital]
        starts = heads
        if self.marks_apart:
            kind = KIND[data]
            last = first[1:].copy()
            last[:-1] |= space[1:]
            last[1:] &= kind[:-1] == ALNUM
            starts = np.flatnonzero((first[:-1] & ~space) | (~first[:-1] & last & (kind == MARK)))
        offsets = np.append(starts, len(low))
        found = pa.Array.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(low)]).dictionary_encode()
        chunks = [c.rstrip(b" ") for c in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        return found.indices, chunks, np.searchsorted(starts, at)

    def learn(self, new: set[bytes]) -> None:
        """Encode unknown chunks: those of small ASCII letters are one word, the others have the words the splitter finds."""
        single = {c for c in new if c.isalpha() and c.islower()} if self.lone else set()
        parts = {c: self.split.words(c.decode("utf-8")) for c in new - single}
        words = {s: np.array([i], self.dtype).tobytes() for s, i in self.special.items()}
        missing = {c.decode("ascii") for c in single}
        for w in set().union(*parts.values()).difference(words, missing):
            # a word of old characters is the only word of the chunk that it would be
            ids = self.known.get(w.encode("utf-8")) if self.split.old(w) else None
            missing.add(w) if ids is None else words.update({w: ids})
        missing = list(missing)
        words.update(zip(missing, self.encode(missing)))
        self.known.update([(c, words[c.decode("ascii")]) for c in single])
        self.known.update([(c, b"".join([words[w] for w in own])) for c, own in parts.items()])

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word; the model gets them in groups, and the tokens that end a word part their ids again."""
        code, size = "H" if self.dtype.itemsize == 2 else "I", self.dtype.itemsize
        groups = [" ".join(words[a:a + GROUP]) for a in range(0, len(words), GROUP)]
        flat = b"".join([array(code, e.ids).tobytes() for e in self.model.encode_batch_fast(groups, add_special_tokens=False)])
        to = ((np.flatnonzero(self.ends[np.frombuffer(flat, self.dtype)]) + 1) * size).tolist()
        if len(to) != len(words):       # a vocabulary without such tokens
            return [array(code, e.ids).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return [flat[a:b] for a, b in zip([0, *to], to)]

    def run(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        codes, chunks, first = self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new = set(chunks).difference(self.known)
        back = new.intersection(self.older)
        self.known.update([(c, self.older[c]) for c in back])
        self.learn(new - back)
        ids = pa.array(list(map(self.known.__getitem__, chunks)), pa.large_binary()).take(codes)
        for c in [c for c in new if len(c) > LONGEST]:
            del self.known[c]
        if not len(ids):
            return [b""] * len(texts)
        stream = ids.buffers()[2]
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist()
        return [stream[a:b].to_pybytes() for a, b in zip(bounds, bounds[1:])]


def occurrences(data: bytearray, part: bytes):
    """Places of ``part`` in ``data``; every place where it is empty."""
    at = data.find(part)
    while 0 <= at < len(data):
        yield at
        at = data.find(part, at + 1)


def word_model(tok):
    """The library's tokenizer for normalised words between single spaces: the same model, of the steps before it only the
    byte alphabet.  And what the last token of a word ends with, if the vocabulary has that."""
    from tokenizers import Tokenizer

    spec = json.loads(tok.to_str())
    steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
    apart = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    spec.update(normalizer=None, added_tokens=[],
                pre_tokenizer={"type": "Sequence", "pretokenizers": [apart, next(s for s in steps if s["type"] == "ByteLevel")]})
    return Tokenizer.from_str(json.dumps(spec)), spec["model"].get("end_of_word_suffix")


def _library(name: str) -> LibraryWords:
    return kept(("library", name), lambda: LibraryWords(name))


class SequenceWriter:
    """One Arrow stream-file of fixed-size lists; ids come in any portions."""

    def __init__(self, folder: str, part: int, attempt: int, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        from pyarrow import fs

        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.tmp = f"{base}/part-{part:06d}.arrow", f"{base}/_part-{part:06d}-{attempt}"
        self.length, self.block, self.dtype = length, length * rows, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.n_held >= self.block:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = self.n_held - self.n_held % self.block
            for a in range(0, whole, self.block):
                self._write(flat[a:a + self.block], self.block)
            self.held, self.n_held = [flat[whole:].tobytes()], self.n_held - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(ids.size) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            ids = np.zeros(-(-self.n_held // self.length) * self.length, self.dtype)
            ids[:self.n_held] = np.frombuffer(b"".join(self.held), self.dtype)
            self._write(ids, self.n_held)
        self.out.close()
        self.sink.close()
        self.fs.move(self.tmp, self.path)


class SequenceReader:
    """Random access to the ids of one file; slices are views of the memory map."""

    def __init__(self, folder: str, part: int):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}.arrow"
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.views, self.starts, at = [], [], 0
        for i in range(self.file.num_record_batches):
            b = self.file.get_batch(i)
            self.views.append(b.column(0).values.to_numpy(zero_copy_only=True))
            self.starts.append(at)
            at += self.views[-1].size

    def ids(self, start: int, n: int) -> list[np.ndarray]:
        """The ids from ``start`` on, as views of the batches that hold them."""
        i = int(np.searchsorted(self.starts, start, side="right")) - 1
        out = []
        while n > 0:
            view = self.views[i][start - self.starts[i]:][:n]
            out.append(view)
            start, n, i = start + view.size, n - view.size, i + 1
        return out


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", end_id: int = 1,
                 length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """Write the files into ``folder`` and return the stored index (doc_id, part, place, n_tokens)."""

    def write(batches):
        from pyspark import TaskContext

        ctx, lib = TaskContext.get(), _library(name)
        out, end = None, np.array([end_id], lib.dtype).tobytes()
        for b in batches:
            if out is None:
                out = SequenceWriter(folder, ctx.partitionId(), ctx.taskAttemptId(), lib.dtype, length)
            places, counts = [], []
            for ids in lib.run(b.column(1)):
                places.append(out.total)
                out.add(ids + end)
                counts.append(out.total - places[-1])
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([ctx.partitionId()] * n, pa.int32()), pa.array(places, pa.int64()),
                 pa.array(counts, pa.int64())], ["doc_id", "part", "place", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    # equal ids fall into one range partition, so the text decides only inside a task
    index = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, "doc_id long, part int, place long, n_tokens long")
    return stored(index, "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every indexed document, from the files.

    ``start`` adds the ids of all earlier parts: one total for each part, a few
    bytes for each partition, is all that the driver sees."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    bases = index.sparkSession.sparkContext.broadcast(base)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        file, crcs = SequenceReader(folder, part), []
        for place, n in zip(pdf["place"], pdf["n_tokens"]):
            crc = 0
            for view in file.ids(int(place), int(n)):
                crc = zlib.crc32(view.astype("<u4"), crc)
            crcs.append(crc)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["place"] + bases.value[part],
                             "n_tokens": pdf["n_tokens"], "ids_crc32": pd.array(crcs, "int64")})

    return index.groupBy("part").applyInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    folder = shared_folder(spark, "token-files")
    return read_tokens(write_tokens(docs, folder, name), folder)
