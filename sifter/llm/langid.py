"""Operator 3: language identification by compression.

For every language a zstandard raw-content dictionary is made of training texts;
a text is compressed, in blocks of its whole length, with every dictionary, and
the language with the fewest bytes wins.  A narrow margin between the best and
the second best rejects the prediction.

Training is on a bounded sample: ``EXCERPT`` bytes of at most ``DOCS`` labelled
texts of each language (the smallest hashes of doc_id).  All dictionaries are of one
size, that of the language with the most of it: a smaller sample is repeated up to
it, so that a label with few texts neither shrinks the other dictionaries nor gains
by shorter offsets.  There is no least number of training bytes: such a label wins
only where its few words compress a text better than every full dictionary.
``lang`` is taken to be a small label set.
Texts are reduced to lower-case words before they are compressed.  Predictions
use the whole text and nothing else.

Defined cases: a text that is null or has no letter is ``und``, score 0,
rejected; ties go to the language with more training rows, then by name; with
no labelled row at all everything is ``und``; repeated rows give repeated rows;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.llm.common import kept

#: Bounds of the training sample, and the block of a text that is compressed at once.
DOCS = 128
EXCERPT = 1000
BLOCK = 1024
LEVEL = 6
#: Characters of a text that are looked at for one byte of its excerpt.
WIDER = 4
#: Rejected when (second - best) / second is smaller.
MIN_MARGIN = 0.004


NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_only(text: str) -> bytes:
    """Lower-case words, one space between them."""
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def dictionaries(docs: DataFrame, trains: Column, n_docs: int = DOCS, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Language -> raw dictionary content, most frequent language first."""
    labelled = docs.where(trains & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # rows are ranked, not ids, and cut before they leave their task: the driver gets n_docs excerpts a language
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "excerpt")
    picked = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, WIDER * excerpt).alias("excerpt")).withColumn(
        "r", F.row_number().over(first)).where(F.col("r") <= n_docs).select("lang", "h", "excerpt")
    content: dict[str, bytes] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["h"], r["excerpt"])):
        content[r["lang"]] = content.get(r["lang"], b"") + words_only(r["excerpt"])[:excerpt] + b" "
    size = min(n_docs * excerpt, max(map(len, content.values()), default=0))
    return {k: (content[k] * -(-size // len(content[k])))[:size] for k in sorted(content, key=lambda k: (-sizes[k], k))}


class Classifier:
    """Compresses texts with each language's dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        import zstandard

        self.block, self.langs, self.press = block, list(contents), []
        for c in contents.values():
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False,
                                                       write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = words_only(text)
        blocks = [data[a:a + self.block] for a in range(0, len(data), self.block)]
        return [sum(len(press(b)) for b in blocks) for press in self.press]

    def predict(self, text: str, min_margin: float) -> tuple[str, float, bool]:
        """Language, confidence (softmax of the byte differences) and whether it is rejected."""
        if not self.langs:
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        score = 1 / (1 + sum(math.exp(-min(s - sizes[best], 700)) for s in rest))
        return self.langs[best], score, margin < min_margin


def _classifier(shared) -> Classifier:
    return kept(("langid", shared.id), lambda: Classifier(shared.contents))


class _Shared:
    """Dictionaries as sent to the tasks, with a name by which a worker keeps the compressors."""

    def __init__(self, contents: dict[str, bytes]):
        import uuid

        self.contents, self.id = contents, uuid.uuid4().hex


def predictions(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(contents))

    def predict(batches):
        c = _classifier(shared.value)
        for b in batches:
            out = [c.predict(t, min_margin) if ok else ("und", 0.0, True)
                   for t, ok in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            lang, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, contents: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised."""
    shared = docs.sparkSession.sparkContext.broadcast(_Shared(contents))
    at = docs.columns.index("text")

    def keep(batches):
        c = _classifier(shared.value)
        for b in batches:
            yield b.filter(pa.array([any(map(str.isalpha, t or "")) and not c.predict(t, min_margin)[2]
                                     for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
