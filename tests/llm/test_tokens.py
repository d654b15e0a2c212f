"""Token counts, BPE and token files against the tokenizer library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sifter.llm import bpe_codec, token_counts, token_file
from sifter.llm.common import load_tokenizer, pack_sorted, prepare, shared_folder, tokenizer_path, unpack_sorted
from tests.llm.helpers import edge_docs, edge_rows, empty_docs

ALPHABET = "aAbcé'sΣςİ ß  \n\t\x85\xa0\x1c12½①٣𝟘abc!?._漢字한글​́éǅﬁ🙂’—|<>"


def random_texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)] + [
        "aaaaaaa aaaa aaaaaaaaaaaaaaaaa", "a<|endoftext|>b<|startoftext|>  c", "<|endoftext|><|endoftext|>", "lolololololol"]


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def test_pair_index_equals_library():
    tok, texts = load_tokenizer("word_bpe_49k.json"), random_texts()
    counts, ids, decoded = bpe_codec.codec("word_bpe_49k.json").run(texts)
    for t, n, i, d, e in zip(texts, counts, ids, decoded, tok.encode_batch(texts, add_special_tokens=False)):
        assert n == len(e.ids) and i == " ".join(map(str, e.ids)) and d == tok.decode(e.ids, skip_special_tokens=False), t


def test_codec_over_edges(spark):
    tok = load_tokenizer("word_bpe_49k.json")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe_codec.encode_decode(edge_docs(spark)).collect())
    expect = []
    for d, t, *_ in edge_rows():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expect.append((d or -1, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(expect)
    assert bpe_codec.encode_decode(empty_docs(spark)).count() == 0


def test_token_counts_equal_library(spark):
    tok = load_tokenizer("byte_bpe_50k.json")
    texts = [(d, t) for d, t, *_ in edge_rows()] + list(enumerate(random_texts(), 1000))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expect = sorted((d or -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in texts)
    for frequent in (50_000, 3):                    # the tiers change nothing but the cost
        got = token_counts.count_tokens(docs, frequent=frequent).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == expect
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0


def test_token_files_round_trip(spark):
    tok = load_tokenizer("word_bpe_49k.json")
    got = token_file.token_digest(spark, edge_docs(spark)).collect()
    rows = sorted(((d, t) for d, t, *_ in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start, expect = 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((d or -1, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(expect)
    assert token_file.token_digest(spark, empty_docs(spark)).count() == 0


def test_token_file_format(spark):
    """Equal-length sequences, masks only over real ids, views into the map."""
    import pyarrow as pa
    from pyarrow import fs
    folder = shared_folder(spark, "format-test")
    writer = token_file.SequenceWriter(folder, 3, 0, np.dtype("<u2"), length=8, rows=4)
    rng, docs = np.random.default_rng(1), []
    for n in (1, 7, 8, 100, 0, 33, 5):
        docs.append(rng.integers(0, 49_408, n).astype("<u2"))
        writer.add(docs[-1].tobytes())
    writer.close()
    reader, at = token_file.SequenceReader(folder, 3), 0
    for d in docs:
        views = reader.ids(at, d.size)
        assert np.array_equal(np.concatenate(views) if views else d[:0], d) and not any(v.flags.owndata for v in views)
        at += d.size
    system, base = fs.FileSystem.from_uri(folder)
    table = pa.ipc.open_file(system.open_input_file(f"{base}/part-000003.arrow")).read_all()
    assert str(table.schema.field("ids").type) == "fixed_size_list<item: uint16>[8]"
    mask = np.concatenate([np.array(x) for x in table["mask"].to_pylist()])
    assert mask.sum() == at and mask[:at].all() and mask.size == -(-at // 8) * 8


def test_packed_keys():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), np.arange(5, dtype=np.uint64),
                 np.array([0, (1 << 64) - 1], np.uint64), np.array([7], np.uint64), np.zeros(0, np.uint64)):
        keys = np.unique(keys)
        assert np.array_equal(unpack_sorted(pack_sorted(keys)) if keys.size else keys, keys)


def unicode_texts():
    """Every code point but ideographs, Hangul, surrogates and private ones in four contexts, and orders of combining marks."""
    skip = [(0x3400, 0x9FFF), (0xAC00, 0xDFFF), (0xE000, 0xF8FF), (0x17000, 0x18CFF), (0x20000, 0x10FFFF)]
    points = [chr(p) for p in range(0x20000) if not any(a <= p <= z for a, z in skip)]
    for contexts in ("{0}", "a{0}", "{0}b1", "Aé{0}̣́ x{0}"):
        # twenty a text keep the number of texts small; white space between them keeps them apart
        yield [" ".join(contexts.format(c) for c in points[i:i + 20]) for i in range(0, len(points), 20)]
    marks = "゙्ְཱ̣৾́̇᪰"
    yield [f"{base}{a}{b}{c}" for base in "raরकi" for a in marks for b in marks for c in marks]


def test_all_code_points_equal_library():
    tok, codec, words = load_tokenizer("word_bpe_49k.json"), bpe_codec.Codec(tokenizer_path("word_bpe_49k.json")), token_file.LibraryWords("word_bpe_49k.json")
    for texts in unicode_texts():
        expect = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [list(map(int, i.split())) for i in codec.run(texts)[1]] == expect
        assert [np.frombuffer(b, words.dtype).tolist() for b in words.run(texts)] == expect


def test_caches_change_nothing(monkeypatch):
    """Evicted and long chunks, chunks that are words of others, special strings in any case."""
    tok, texts = load_tokenizer("word_bpe_49k.json"), random_texts(200) + [
        "Hello, hello HELLO hello's x" + "y" * 100 + " <|endoftext|>x <|ENDOFTEXT|> a<|endoftext|> 漢 Hello", "İ İ, i̇ ǅ, ǆ"] * 2
    expect = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for module in (bpe_codec, token_file):
        monkeypatch.setattr(module, "CACHE", 5)
    codec, words = bpe_codec.Codec(tokenizer_path("word_bpe_49k.json")), token_file.LibraryWords("word_bpe_49k.json")
    for at in range(0, len(texts), 7):
        part = texts[at:at + 7]
        assert [list(map(int, i.split())) for i in codec.run(part)[1]] == expect[at:at + 7]
        assert [np.frombuffer(b, words.dtype).tolist() for b in words.run(part)] == expect[at:at + 7]


def test_words_of_a_batch_equal_library(monkeypatch):
    """Capitals that compose otherwise than small letters, marks behind words, texts that touch, groups of words and generations."""
    import pyarrow as pa
    tok = load_tokenizer("word_bpe_49k.json")
    texts = ["J\u030c H\u0331 J", "j\u030c h\u0331 j", "\u030cx", None, "", "word", "word", ", word,", "a,. b.! c\x1c, 1, é, É,x", " \t\v\f\r\n ", "x", "<|", "endoftext|>",
             "<|endoftext|>, <|ENDOFTEXT|>. A<|endoftext|>B", "tail\u00a0Tail,\u2003T\u0308,", "Q" * 100 + ", " + "q" * 100, "it'S, 'S. I'LL!"]
    texts += random_texts(300) + [" ".join(f"{a}{b}{c}" for b in "abcdefghijkl" for c in "abcdefghijkl") for a in "XYZ"]
    expect = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for cache, group, step in ((token_file.CACHE, token_file.GROUP, len(texts)), (20, 3, 5), (0, 1, 1)):
        monkeypatch.setattr(token_file, "CACHE", cache)
        monkeypatch.setattr(token_file, "GROUP", group)
        words = token_file.LibraryWords("word_bpe_49k.json")
        for repeat in range(2):
            for a in range(0, len(texts), step):
                part = pa.array(["left out", *texts[a:a + step]])[1:]
                assert [np.frombuffer(b, words.dtype).tolist() for b in words.run(part)] == expect[a:a + step]
    words = token_file.LibraryWords("word_bpe_49k.json")
    assert not words.ends[:words.model.get_vocab()["a</w>"]].all() and words.encode([]) == []
    ids = words.encode(["hello", "sttible", ","])
    words.ends[:] = False                           # a vocabulary without ends of words
    assert words.encode(["hello", "sttible", ","]) == ids
    assert words.run([]) == []


def test_words_used_lately_are_not_encoded_again(monkeypatch):
    """A full cache keeps a generation: words of the batch before the last are looked up."""
    class Counting:
        def __init__(self, model):
            self.model, self.seen = model, []

        def encode_batch_fast(self, words, **options):
            self.seen += words
            return self.model.encode_batch_fast(words, **options)

    monkeypatch.setattr(token_file, "CACHE", 4)
    words = token_file.LibraryWords("word_bpe_49k.json")
    words.model = Counting(words.model)
    before = words.run(["one two three four five six"])
    words.run(["seven"])
    words.model.seen.clear()
    assert words.run(["six five four three two one", "one two three four five six"])[1:] == before and not words.model.seen
