"""Shared helpers of the training-data operators: tables, settings, stored intermediate tables, packed keys."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.session import apply_required, ensure_checkpoint_dir

#: Bytes of one Arrow batch sent to a Python worker; long texts must not add up to gigabytes.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on (bounded Arrow batches, shipped package)."""
    apply_required(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage
    (lost executors re-read the table) and fixes the rows for every later use."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one number)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder`` (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


# ---------------------------------------------------------------- inside tasks

_KEPT: dict = {}


def kept(key, build):
    """What an operator keeps in a Python worker between batches and tasks (caches, compressors).  Workers serve
    one operator after another, so only the last one's is held."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def release() -> None:
    """For operators that keep nothing: give back what an earlier one has left."""
    _KEPT.clear()


def in_portions(texts: list, chars: int):
    """Ranges (from, to) of the texts with about ``chars`` characters each, a longer text alone."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > chars:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split cuts at exactly these)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word: the distinct words are hashed once and taken by code."""
    import pandas as pd
    import pyarrow as pa

    if not words:
        return np.zeros(0, np.uint64)
    d = pa.array(words, pa.binary()).dictionary_encode()
    distinct = d.dictionary.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(distinct, categorize=False)[d.indices.to_numpy()]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences of six bytes each (eight where one is larger)."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    head = gaps[:1].tobytes()
    rest = np.ascontiguousarray(gaps[1:])
    wide = bool(rest.size) and int(rest.max()) >= 1 << 48
    body = rest.tobytes() if wide else np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return bytes([wide]) + head + body


def unpack_sorted(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8, offset=9)
    if data[0]:
        rest = raw.view(np.uint64) if raw.size % 8 == 0 and raw.flags.aligned else np.frombuffer(raw.tobytes(), np.uint64)
    else:
        full = np.zeros((raw.size // 6, 8), np.uint8)
        full[:, :6] = raw.reshape(-1, 6)
        rest = full.view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(data[1:9], np.uint64), rest]), dtype=np.uint64)


def by_bucket(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty ranges of sorted keys; buckets split the key space evenly."""
    if not sorted_keys.size:
        return []
    at = ((sorted_keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(at)) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [at.size]])
    return [(int(at[a]), int(a), int(b)) for a, b in zip(starts, ends)]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine (driver or worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path_or_name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path_or_name if os.path.sep in path_or_name else tokenizer_path(path_or_name))
    tok.no_truncation()
    tok.no_padding()
    return tok
