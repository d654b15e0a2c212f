"""Operator 2: language-model scores by a weighted backoff automaton.

Every n-gram of the training texts is a state of the automaton.  From the state
of a context an arc leads on for each word that was seen after it; its weight is
the smoothed probability

    p(w | context) = (c(context w) + MU * p(w | shorter context)) / (c(context) + MU),

and the failure arc, weight MU / (c(context) + MU), leads to the state of the
shorter context.  The root has p(w) = (c(w) + 1) / (N + V + 1), one share being
left for all unknown words.  A text is read once from left to right: the state
is carried from token to token, failure arcs are followed until an arc fits, and
the log10 weights are added up.

Counts cover all training texts and live nowhere as a whole.  Texts are dealt
into blocks; a block sends its distinct n-grams (57-bit hashes in sorted, packed
cells, one for each bucket of the hash space), a bucket adds up the counts and
sends back one byte for each n-gram (the total, or that the block's own count is
all there is), and the block, now holding the arcs and states its texts need,
scores them.  Hot
n-grams cost one entry for each block.

Tokens: A-Z lower-cased words between white space, then one end token.  Defined
cases: null or empty text is the end token alone; a null doc_id is not held
out; repeated rows train and are scored each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import (ascii_words, by_bucket, mix64, pack_sorted, shuffle_partitions, text_bytes, unpack_sorted,
                               word_hashes)

ORDER = 3
MU = 10.0
#: Low bits that n-gram keys do without: 57 bits tell n-grams apart, and sorted ones differ by five bytes.
DROPPED = np.uint64(7)
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
END = np.uint64(0x1B873593CC9E2D51)
START = np.uint64(0x38B34AE5A1E38B93)
SALTS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(8)]
STARTS = [np.uint64((int(START) + int(s)) % (1 << 64)) for s in SALTS]


def token_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text after text with its end token, and the place of each text's first token."""
    words, sizes = [], []
    for t in texts:
        own = ascii_words(t)
        words += own
        sizes.append(len(own))
    sizes = np.array(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    out = np.full(len(words) + sizes.size, END)
    ends = starts + sizes
    inner = np.ones(out.size, bool)
    inner[ends] = False
    out[inner] = word_hashes(words)
    return out, starts


def gram_keys(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Key of the n-gram that ends at each token, for n = 1 to ``order``; contexts reach back to a start mark."""
    cut = ~np.uint64((1 << int(DROPPED)) - 1)
    grams, out = tokens, [mix64(tokens ^ SALTS[0]) & cut]
    for k in range(1, order):
        before = np.empty_like(grams)
        before[1:] = grams[:-1]
        before[starts] = STARTS[k]
        grams = mix64(before) + tokens
        out.append(mix64(grams ^ SALTS[k]) & cut)
    return out


def training_size(rows: DataFrame, buckets: int) -> tuple[int, int]:
    """N and V: all tokens and distinct tokens of the training texts."""

    def count(batches):
        n, parts, held = 0, [], 0
        for b in batches:
            tokens, _ = token_hashes([t for t, train in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if train])
            n += tokens.size
            parts.append(np.unique(tokens))
            held += parts[-1].size
            if held > 4_000_000:
                yield cells(np.unique(np.concatenate(parts)), 0)
                parts, held = [], 0
        yield cells(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), n)

    def cells(keys: np.ndarray, n: int) -> pa.RecordBatch:
        cut = by_bucket(keys, buckets)
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([b for b, _, _ in cut] + [-1], pa.int32()),
            "keys": pa.array([pack_sorted(keys[i:j]) for _, i, j in cut] + [b""], pa.binary()),
            "n": pa.array([0] * len(cut) + [n], pa.int64())})

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([unpack_sorted(k) for k in pdf["keys"]]))
        return pd.DataFrame({"v": [keys.size], "n": [int(pdf["n"].sum())]})

    made = rows.select("text", "train").mapInArrow(count, "bucket int, keys binary, n long")
    r = made.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(sizes, "v long, n long").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(r["n"] or 0), int(r["v"] or 0)


def squeezed(plane: np.ndarray) -> bytes:
    """Bytes of little entropy (high bytes, counts), compressed: the shuffle's own codec does not code entropy."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(plane.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def pack_grams(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of five bytes each (eight where one is larger): four as they are, the high ones apart."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    rest = np.ascontiguousarray(gaps[1:] >> DROPPED)
    head = gaps[:1].tobytes()
    if rest.size and int(rest.max()) >= 1 << 40:
        return b"\1" + head + rest.tobytes()
    planes = rest.view(np.uint8).reshape(-1, 8)
    return b"\0" + head + np.ascontiguousarray(planes[:, :4]).tobytes() + squeezed(np.ascontiguousarray(planes[:, 4])) + rest.size.to_bytes(4, "little")


def unpack_grams(data: bytes) -> np.ndarray:
    if data[0]:
        rest = np.frombuffer(data[9:], np.uint64)
    else:
        n = int.from_bytes(data[-4:], "little")
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :4] = np.frombuffer(data, np.uint8, 4 * n, 9).reshape(-1, 4)
        planes[:, 4] = unsqueezed(data[9 + 4 * n:-4])
        rest = planes.view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(data[1:9], np.uint64), rest << DROPPED]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte for each count; 255 stands for one that is in the second part."""
    large = counts >= 255
    return squeezed(np.where(large, 255, counts).astype(np.uint8)), counts[large].astype("<i8").tobytes()


def unpack_counts(small: bytes, large: bytes) -> np.ndarray:
    out = unsqueezed(small).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


class BlockCounts:
    """Distinct n-grams of a block with their training counts."""

    def __init__(self, pdf: pd.DataFrame, order: int):
        self.tokens, self.starts = token_hashes(pdf["text"].where(pdf["text"].notna(), None))
        sizes = np.diff(np.concatenate([self.starts, [self.tokens.size]]))
        self.keys, self.at = np.unique(np.concatenate(gram_keys(self.tokens, self.starts, order)), return_inverse=True)
        weights = np.repeat(pdf["train"].to_numpy(bool), sizes)
        self.counts = np.bincount(self.at, np.tile(weights, order), self.keys.size).astype(np.int64)


def _count_block(order: int, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = BlockCounts(pdf, order)
        cut = by_bucket(own.keys, buckets)
        counts = [pack_counts(own.counts[i:j]) for _, i, j in cut]
        return pd.DataFrame({"bucket": [b for b, _, _ in cut], "block": int(pdf["block"].iloc[0]),
                             "keys": [pack_grams(own.keys[i:j]) for _, i, j in cut],
                             "counts": [c for c, _ in counts], "many": [m for _, m in counts]})
    return run


def _sum_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of a bucket's n-grams, told to each block that has sent some."""
    keys = [unpack_grams(k) for k in pdf["keys"]]
    sizes = [k.size for k in keys]
    own = np.concatenate([unpack_counts(c, m) for c, m in zip(pdf["counts"], pdf["many"])])
    flat = np.concatenate(keys)
    by = np.argsort(flat, kind="stable")
    ordered = flat[by]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums = np.add.reduceat(own[by], first)
    total = np.empty_like(own)
    total[by] = np.repeat(sums, np.diff(np.concatenate([first, [flat.size]])))
    # one byte for each n-gram of a block's cell, in its order: 0 where the block's own count is all there is,
    # the total up to 254, or 255 with the total in ``large``
    code = np.where(total == own, 0, np.minimum(total, 255)).astype(np.uint8)
    ends = np.cumsum(sizes)
    out = [(block, bucket, squeezed(code[e - n:e]), total[e - n:e][code[e - n:e] == 255].tobytes())
           for block, bucket, n, e in zip(pdf["block"], pdf["bucket"], sizes, ends)]
    return pd.DataFrame(out, columns=["block", "bucket", "codes", "large"])


def _score_block(order: int, buckets: int, n_train: int, vocabulary: int, train_docs: int, mu: float):
    def run(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        own = BlockCounts(pdf, order)
        counts = own.counts
        cells = {b: (i, j) for b, i, j in by_bucket(own.keys, buckets)}
        for bucket, codes, large in zip(sent["bucket"], sent["codes"], sent["large"]):
            i, j = cells[bucket]
            code = unsqueezed(codes)
            total = np.where(code == 0, counts[i:j], code)
            total[code == 255] = np.frombuffer(large, np.int64)
            counts[i:j] = total
        per_order = counts[own.at].reshape(order, -1).astype(np.float64)
        root = np.log10(per_order[0] + 1) - np.log10(n_train + vocabulary + 1)
        score, failures = walk(per_order, own.starts, root, train_docs, mu)
        add = lambda x: np.add.reduceat(x, own.starts)
        ones = np.ones(root.size, np.int64)
        return pd.DataFrame({"doc_id": pdf["doc_id"].array, "held_out": ~pdf["train"].to_numpy(bool), "n_tokens": add(ones),
                             "n_known": add((per_order[0] > 0).astype(np.int64)), "train_tokens": n_train,
                             "base_score": add(root), "score": add(score), "n_failures": add(failures)})
    return run


def walk(counts: np.ndarray, starts: np.ndarray, root: np.ndarray, train_docs: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 weight of each token's path and its number of failure arcs.

    ``counts[k]`` is the count of the (k + 1)-gram that ends at each token.  The state carried to a token is the longest
    n-gram that was matched up to the token before (shorter than the order), at the start of a text the start state,
    which all training texts have; from it failure arcs lead to shorter contexts until an arc fits.  Weights are
    put together from the shortest context up to the state."""
    order = counts.shape[0]
    matched = np.cumprod(counts > 0, axis=0).sum(0)
    state = np.empty(root.size, np.int64)
    state[1:] = np.minimum(matched[:-1], order - 1)
    state[starts] = order - 1
    logp, failures = root, np.zeros(root.size, np.int64)
    for k in range(1, order):
        context = np.empty(root.size)
        context[1:] = counts[k - 1][:-1]
        context[starts] = train_docs
        on = state >= k
        arc = on & (counts[k] > 0)
        passed = np.log10(mu / (context + mu)) + logp
        with np.errstate(divide="ignore"):
            taken = np.log10(np.where(arc, counts[k], 1) + mu * 10.0 ** logp) - np.log10(context + mu)
        failures = np.where(arc, 0, failures + on)
        logp = np.where(arc, taken, np.where(on, passed, logp))
    return logp, failures


def score_texts(docs: DataFrame, train: Column, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_failures) of every row
    of (doc_id, text); the model learns from the rows where ``train`` is true."""
    blocks = max(shuffle_partitions(docs.sparkSession), -(-text_bytes(docs) // block_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    n_train, vocabulary = training_size(rows, blocks)
    train_docs = rows.where("train").count()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    cells = dealt.groupBy("block").applyInPandas(_count_block(order, blocks), "bucket int, block int, keys binary, counts binary, many binary")
    sums = cells.repartition(blocks, "bucket").groupBy("bucket").applyInPandas(
        _sum_bucket, "block int, bucket int, codes binary, large binary")
    score = _score_block(order, blocks, n_train, vocabulary, train_docs, mu)
    return dealt.groupBy("block").cogroup(sums.repartition(blocks, "block").groupBy("block")).applyInPandas(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double, n_failures long")
